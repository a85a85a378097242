import numpy as np
import pytest

from lexispark.llm import minhash as mh

SCHEMA = "doc_id long, text string, n long, digest string, keys int"


def brute(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        grams = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
        sets.setdefault(i, grams)
    head = {i: i for i in sets}

    def root(x):
        while head[x] != x:
            x = head[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            common = len(sets[a] & sets[b])
            if a < b and common and 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                x, y = root(a), root(b)
                head[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def corpus(seed=3):
    rng = np.random.default_rng(seed)
    word = lambda: f"w{rng.integers(0, 4000)}"
    rows, i = [], 0
    for _ in range(12):
        base = [word() for _ in range(int(rng.integers(40, 160)))]
        for _ in range(int(rng.integers(2, 16))):
            text = list(base)
            for _ in range(int(rng.integers(0, 7))):
                text[int(rng.integers(0, len(text)))] = word()
            rows.append((i, " ".join(text)))
            i += 1
    rows += [(i, None), (i + 1, ""), (i + 2, " \t\n"), (i + 3, "a b c"), (i + 4, "A B  C"), (i + 5, "a b c d e"), (i + 6, rows[0][1].upper()), (i + 7, "z " * 30000), (i + 8, "é É"), (i + 9, "é É")]
    return rows


@pytest.mark.parametrize("small", [32, 2])
def test_against_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(mh, "SMALL_BUCKET", small)
    monkeypatch.setattr(mh, "BLOCK", 5)
    rows = corpus()
    got = mh.near_dedup(spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], SCHEMA)).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_shingles, r.component_id, r.kept) == (*want[r.doc_id], want[r.doc_id][1] == r.doc_id)


def test_repeated_rows_and_empty_table(spark):
    assert mh.near_dedup(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(1, "a b c d e f g", 1, "x", 2), (1, "a b c d e f g", 1, "x", 2), (2, "a b c d e f g", 1, "x", 2), (None, "a b c d e f g", 1, "x", 2)]
    got = sorted((r.doc_id or 0, r.component_id, r.kept) for r in mh.near_dedup(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(0, None, False), (1, 1, True), (1, 1, True), (2, 1, False)]


def test_estimate_is_corrected_for_collisions():
    rng = np.random.default_rng(1)
    for share in (0.0, 0.5, 0.75, 1.0):
        off = []
        for _ in range(30):
            n = 300
            both = int(2 * n * share / (1 + share))
            x = rng.integers(0, 2**63, 2 * n - both, dtype=np.uint64)
            a, b = np.unique(x[:n]), np.unique(x[n - both :])
            agree = (mh.registers(a) == mh.registers(b)).mean()
            off.append(float(mh.estimate(agree, len(a), len(b))[0]) - share)
        assert abs(np.mean(off)) < 0.03


def test_one_identifier_with_several_texts(spark):
    a, b, c, d = (" ".join(f"{k}{i}" for i in range(40)) for k in "abcd")
    near = lambda t: t.replace("0 ", "zero ", 1)
    rows = [(5, a), (5, b), (9, near(b)), (3, near(a)), (7, c), (8, d), (8, None), (8, ""), (6, None), (None, a), (4, "few words"), (4, near(d))]
    texts = {}
    for i, t in rows:
        if i is not None:
            texts.setdefault(i, []).append(t)
    gram = lambda t: {tuple(w[k : k + 5]) for w in [(t or "").split()] for k in range(max(1, len(w) - 4)) if w}
    like = lambda x, y: bool(gram(x)) and 4 * len(gram(x) & gram(y)) >= 3 * len(gram(x) | gram(y))
    low = {i: i for i in texts}
    for _ in texts:
        for i in texts:
            low[i] = min(low[j] for j in texts if i == j or any(like(x, y) for x in texts[i] for y in texts[j]))
    got = mh.near_dedup(spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], SCHEMA)).collect()
    want = sorted((i or 0, len(gram(t)), low.get(i) or 0, low.get(i) == i and i is not None) for i, t in rows)
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0, r.kept) for r in got) == want
