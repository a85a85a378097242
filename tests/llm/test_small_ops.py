import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lexispark.llm.lm import exchange, lm_scores
from lexispark.llm.mixing import flight, mix_sources
from lexispark.llm.rollups import TokenRollup, maintained
from lexispark.llm.topk import exact_topk
from lexispark.llm.toxicity import Lexicon, Model, Trie, features, reject, score, train


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def test_trie_and_automaton_agree_with_edit_distance():
    rng = np.random.default_rng(2)
    word = lambda: "".join(rng.choice(list("abc"), int(rng.integers(1, 8))))
    terms = sorted({word() for _ in range(60)})
    trie = Trie(terms)
    for _ in range(300):
        w = word()
        for k in (0, 1, 2):
            near = sorted((edit_distance(w, t), t) for t in terms if edit_distance(w, t) <= k)
            assert trie.find(w, k) == ((near[0][1], near[0][0]) if near else None)


def test_misspellings_against_edit_distance():
    rng = np.random.default_rng(5)
    word = lambda n: "".join(rng.choice(list("abcd"), n))
    terms = sorted({word(int(n)) for n in rng.integers(3, 13, 900)})
    lex = Lexicon(dict.fromkeys(terms, 1.0))
    allowed = lambda t: 0 if len(t) < 5 else 1 if len(t) < 9 else 2
    made = []
    for t in terms:
        x = list(t)
        for _ in range(int(rng.integers(0, 4))):
            at = int(rng.integers(0, len(x))) if x else 0
            kind = rng.integers(3)
            x[at : at + (kind > 0)] = [] if kind == 1 else [str(rng.choice(list("abcdé")))]
        made.append("".join(x))
    for w in made:
        if not w:
            continue
        want = 1 if w in terms else 3 if any(edit_distance(w, t) <= allowed(t) for t in terms) else 0
        assert lex.matches([w]).get(w, (0, 0.0))[0] == want, w


def test_context_windows():
    lex = Lexicon({"idiot": 5.0})
    one = math.log1p(5.0)
    quoted, reported, addressed = 3, 4, 5
    plain = features("he is an idiot now", lex)
    assert plain[:3] == [one, 0, 0] and plain[3:6] == [0, 0, 0]
    assert features('he wrote "an idiot" now', lex)[quoted] == one and features('"so" he is an idiot "then"', lex)[quoted] == 0
    assert features('"an idiot without an end', lex)[quoted] == 0 and features('"' + "far " * 3000 + "idiot " + "far " * 3000 + '"', lex)[quoted] == one
    assert features("they said idiot here", lex)[reported] == one and features("you idiot", lex)[addressed] == one
    assert features("he is an idoit idiott", lex)[2] == one and features("", lex) == [0.0] * 8


def test_scores_are_those_of_the_formula(spark):
    lex = Lexicon({"scum": 3.0, "disgusting": 2.0}, {"loser": 1.0})
    beta = np.array([-2.0, 1.5, 0.5, 0.25, -1.0, -0.5, 0.75, 0.1, 0.2])
    model = Model(lex, np.full(8, 0.1), np.full(8, 2.0), beta)
    texts = ["scum", "a disgusting losers thing", 'you said "scum" and disgsting', "clean words", None, "", "clean " * 60000 + "scum"]
    sums = [[3, 0, 0, 0, 0, 0, 3, 10], [2, 1, 0, 0, 0, 0, 2, 10], [3, 0, 2, 3, 5, 5, 3, 10], [0] * 8, [0] * 8, [0] * 8, [3, 0, 0, 0, 0, 0, 3, 100 / 60001]]
    x = (np.array([[*map(math.log1p, r[:6]), *r[6:]] for r in sums]) - 0.1) / 2.0
    want = 1 / (1 + np.exp(-(beta[0] + x @ beta[1:])))
    rows = [(i, t, 1.0, "k") for i, t in enumerate(texts)] + [(0, "scum", 1.0, "k")]
    got = score(spark.createDataFrame(rows, "doc_id long, text string, score double, y string"), model).collect()
    assert len(got) == len(rows) and all(r.score == pytest.approx(want[r.doc_id]) for r in got)
    kept = reject(spark.createDataFrame(rows, "doc_id long, text string, score double, y string"), model).collect()
    assert sorted(r.doc_id for r in kept) == sorted(i for i, *_ in rows if want[i] < 0.5)
    assert score(spark.createDataFrame([], "doc_id long, text string"), model).collect() == []


def test_toxicity_learns_and_holds_out(spark):
    rows, labels = [], []
    rng = np.random.default_rng(4)
    for i in range(900):
        bad = i % 6 == 0
        words = [f"w{rng.integers(0, 400)}" for _ in range(30)] + (["vilescum", "badword"] if bad else [])
        rng.shuffle(words)
        rows.append((i, " ".join(words), 1.0, "k"))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame([*rows, (1000, None, 1.0, "k"), (1001, "", 1.0, "k"), (None, "x", 1.0, "k"), (1002, "Vilescum baadword", 0.5, "k")], "doc_id long, text string, score double, y string")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = train(docs, lab)
    got = {r.doc_id: r for r in score(docs, model).collect()}
    assert len(got) == 904
    for i, y in labels:
        assert got[i].predicted == y and got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
    assert got[1000].predicted == got[1001].predicted == 0 and got[1002].predicted == 1
    none = train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert all(r.predicted == 0 for r in score(docs, none).collect())


def test_mixing_hits_targets(spark):
    rng = np.random.default_rng(1)
    rows = [(i, f"s{i % 4}" if i % 9 else None, "w " * int(rng.integers(1, 80)), "x") for i in range(1200)] + [(5000, "tiny", "one two", "x"), (5001, "blank", "", "x"), (5002, "blank", None, "x"), (0, "s0", "again", "x")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, size string")
    got = mix_sources(df, block=64).collect()
    again = mix_sources(df.repartition(7), block=64).collect()
    key = lambda r: (r.doc_id, r.size, r.taken)
    assert Counter(map(key, got)) == Counter(map(key, again)) and len(got) == len(rows)
    sizes = Counter()
    for _, s, t, _ in rows:
        sizes[s] += len((t or "").split())
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: [1, 2, 3][i % 3] for i, s in enumerate(order)}
    target, open_ = {}, set(order)
    while True:
        rest = sum(sizes.values()) - sum(target.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            open_.remove(s)
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source]) and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for s in order:
        assert abs(taken[s] - target[s]) <= max(3, 0.001 * target[s]), (s, taken[s], target[s])
    assert mix_sources(spark.createDataFrame([], "doc_id long, source string, text string")).collect() == []


def test_mixing_of_rows_without_identifiers(spark):
    rows = [(None if i % 2 else 5, "ab"[i % 2], "w " * (1 + i % 9)) for i in range(900)] + [(1, "a", "long " * 50000), (2, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mix_sources(df, block=64).collect()
    assert len(got) == len(rows)
    taken, target = Counter(), {}
    for r in got:
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 3 * r.size
    # the document of 50,000 words is more than its source's target, and what else there is, three times over, is far less: it alone comes nearest
    assert taken["a"] == 50_000 > target["a"] > 47_000
    assert all(abs(taken[s] - target[s]) <= max(3, 0.001 * target[s]) for s in target if s != "a")


@pytest.mark.parametrize("share", [0.01, 0.1, 0.5, 0.8])
def test_mixing_with_a_document_that_dominates_its_source(spark, share):
    rng = np.random.default_rng(12)
    sizes = [int(rng.integers(50, 700)) for _ in range(400)]
    big = int(sum(sizes) * share / (1 - share))
    rows = [(i, "a", "w " * n) for i, n in enumerate([*sizes, big])] + [(1000 + i, "b", "w " * int(rng.integers(1, 900))) for i in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    for block in (64, 4096):
        taken, target = Counter(), {}
        for r in mix_sources(df, block=block).collect():
            taken[r.source] += r.taken
            target[r.source] = r.target
            assert 0 <= r.taken <= 3 * r.size
        assert all(abs(taken[s] - target[s]) <= max(3, 0.001 * target[s]) for s in target), (block, taken, target)


def test_flight_keeps_the_constraints():
    rng = np.random.default_rng(3)
    pi, size = rng.random(500), rng.integers(1, 900, 500).astype(float)
    out = flight(pi, size, rng)
    assert ((out > 1e-9) & (out < 1 - 1e-9)).sum() <= 2
    assert out.sum() == pytest.approx(pi.sum()) and out @ size == pytest.approx(pi @ size, rel=1e-6)


def test_topk_against_brute_force(spark):
    rng = np.random.default_rng(6)
    vec = {i: rng.normal(size=8).astype(np.float32) for i in range(700)}
    for i in range(200, 260):
        vec[i] = vec[200]
    rows = [(i, [float(x) for x in v], "q") for i, v in vec.items()] + [(9000, None, "q"), (9100, [1.0, None], "q"), (9200, [float("nan")] * 8, "q"), (None, [1.0] * 8, "q"), (9300, [float("inf")] * 8, "q")]
    got = exact_topk(spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string"), k=10, every=100).collect()
    ints = {i: np.floor(1024 * v.astype(float)).astype(np.int64) for i, v in vec.items()}
    want = []
    for q in range(0, 700, 100):
        best = sorted(((-int(ints[q] @ ints[c]), c) for c in ints if c != q))[:10]
        want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(best)]
    assert sorted(tuple(r) for r in got) == sorted(want)
    assert exact_topk(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_topk_of_few_repeated_and_large_vectors(spark):
    shape = "vec_id long, embedding array<double>, rank int"
    run = lambda rows, **o: sorted(tuple(r) for r in exact_topk(spark.createDataFrame([(*r, 1) for r in rows], shape), **o).collect())
    # fewer than k; one id twice is one query (its smaller vector) and two candidates
    rows = [(100, [1.0, 0.0]), (100, [0.5, 0.0]), (1, [2.0, 1.0]), (2, [2.0, 1.0]), (200, []), (3, [-1.0])]
    s = 1024 * 1024
    want = [(100, 1, 1, s), (100, 2, 2, s), (100, 3, 200, 0), (100, 4, 3, -s // 2), (200, 1, 1, 0), (200, 2, 2, 0), (200, 3, 3, 0), (200, 4, 100, 0), (200, 5, 100, 0)]
    assert run(rows) == sorted(want)
    assert run([(0, []), (1, [])]) == [(0, 1, 1, 0)]
    # products beyond 2^53 are exact, beyond 2^63 held at a long's ends
    big = [(0, [float(2**45 + 1), 3.0]), (1, [float(2**5 + 1), 1.0]), (2, [float(2**5 + 1), 2.0]), (3, [1e300, 0.0]), (4, [-1e300, 0.0]), (5, [1e307, 1.0])]
    exact = lambda a, b: sum(int(1024 * x) * int(1024 * y) for x, y in zip(a, b, strict=True))
    top = 2**63 - 1
    got = run(big, k=5)
    assert got[0][:3] == (0, 1, 3) and got[0][3] == top and got[-1][3] == -top - 1
    assert [g[2:] for g in got[1:3]] == [(i, min(top, exact(big[0][1], big[i][1]))) for i in (2, 1)]
    assert len(got) == 4  # 1024 times the last one is beyond a double


def test_topk_bound_eliminates(spark):
    from lexispark.llm import topk

    rng = np.random.default_rng(3)
    x = np.floor(1024 * rng.normal(size=(1500, 48)))
    ids = np.arange(len(x))
    p = topk.pivot_rows(x, topk.frame(x[:300], 40))
    q = ids[::100]
    assert (p[q] @ p.T - x[q] @ x.T > -1e-3).all()
    *got, seen = topk._best(x[q], p[q], np.full(len(q), -1e300), q, x, p, ids, 10)
    score = x[q] @ x.T
    score[np.arange(len(q)), q] = -np.inf
    want = np.sort(score, axis=1)[:, -10:][:, ::-1].ravel()
    assert got[2] == want.tolist() and seen < 0.5 * len(q) * len(x)


def test_rollup_is_idempotent(spark, tmp_path):
    roll = TokenRollup(spark, f"file://{tmp_path}/r")
    df = lambda rows: spark.createDataFrame(rows, "source string, lang string, tokenizer string, sign int, n_tokens long, extra string")
    assert roll.totals().collect() == []
    assert roll.apply("a", df([("s", "en", "t1", 1, 5, "x"), ("s", "en", "t1", 1, 7, "x"), (None, "en", "t1", 1, 1, "x"), ("s", "en", "t1", None, 9, "x")]))
    assert not roll.apply("a", df([("s", "en", "t1", 1, 5, "x")]))
    assert roll.apply("b", df([("s", "en", "t1", -1, 5, "x"), ("s", "en", "t1", -1, 7, "x"), ("s", "en", "t1", 1, 8, "x"), (None, "en", "t1", -1, 1, "x")]))
    assert [tuple(r) for r in roll.totals().collect()] == [("s", "en", "t1", 1, 8)]


def test_of_two_writers_one_raises(spark, tmp_path):
    df = lambda n: spark.createDataFrame([("s", "en", "t", 1, n)], "source string, lang string, tokenizer string, sign int, n_tokens long")
    path = f"file://{tmp_path}/r"

    class Slow(TokenRollup):
        def _publish(self, number, batch, state):
            TokenRollup(spark, path).apply("other", df(4))  # comes between this writer's look and its record
            super()._publish(number, batch, state)

    with pytest.raises(RuntimeError):
        Slow(spark, path).apply("mine", df(9))
    roll = TokenRollup(spark, path)
    assert [tuple(r) for r in roll.totals().collect()] == [("s", "en", "t", 1, 4)]
    assert roll.apply("mine", df(9)) and not roll.apply("other", df(4))
    assert [tuple(r) for r in roll.totals().collect()] == [("s", "en", "t", 2, 13)]


def test_maintained_totals_cover_all_rows(spark):
    rows = [(1, "a b", "s", "en"), (2, "a b", "s", "en"), (2, "a b", None, "en"), (3, None, "s", None), (4, "", "t", "en"), (None, "a b", "s", "en"), (None, "only here", "t", "en"), (None, "only here", "t", "en"), (5, "x,y " * 30000, "t", "en")]
    docs = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, source string, lang string, n_tokens int, digest string")
    want = defaultdict(lambda: [0, 0])
    for _, t, s, g in rows:
        words = (t or "").split()
        for kind, n in (("blank-1", len(words) + 1), ("runs-1", sum(len(w.split(",")) for w in words))):
            want[s, g, kind][0] += 1
            want[s, g, kind][1] += n
    assert {(r.source, r.lang, r.tokenizer): [r.n_docs, r.n_tokens] for r in maintained(docs).collect()} == dict(want)
    assert maintained(docs.limit(0)).collect() == []


def test_language_model(spark):
    rng = np.random.default_rng(8)
    subj, verb = [f"n{i}" for i in range(30)], [f"v{i}" for i in range(30)]
    text = lambda: " ".join(x for _ in range(40) for x in (subj[rng.integers(30)], verb[rng.integers(30)]))
    rows = [(i, text(), 1.0, "k") for i in range(120)] + [(500, None, 1.0, "k"), (501, "", 1.0, "k"), (502, "unseenword Another", 1.0, "k"), (1, "n1 v1", 1.0, "k")]
    got = lm_scores(spark.createDataFrame(rows, "doc_id long, text string, score double, h string")).collect()
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    words = lambda t: [*(t or "").encode().lower().split(), b"\n"]
    count = Counter(w for i, t, *_ in rows if not held(i) for w in words(t))
    n, v = sum(count.values()), len(count)
    assert len(got) == len(rows)
    by = defaultdict(list)
    for i, t, *_ in rows:
        w = words(t)
        by[i].append((len(w), sum(count[x] > 0 for x in w), round(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w), 6)))
    for r in got:
        assert r.held_out == held(r.doc_id) and r.train_tokens == n
        assert (r.n_tokens, r.n_known, round(r.base_score, 6)) in by[r.doc_id]
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_language_model_of_nothing_and_of_long_texts(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert lm_scores(empty).collect() == []
    rows = [(None, "held out only"), (4, "B a " * 120000), (5, "a " * 10), (5, "a " * 10)]
    got = {(r.doc_id, r.n_tokens): r for r in lm_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[None, 4].held_out and got[None, 4].n_known == 1 and got[4, 240001].train_tokens == 240001 + 22
    n, v = 240023, 3
    count = {b"a": 120020, b"b": 120000, b"\n": 3}
    assert got[4, 240001].base_score == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in [b"a", b"b"] * 120000 + [b"\n"]))
    alone = lm_scores(spark.createDataFrame([(None, "x y")], "doc_id long, text string")).first()
    assert alone.train_tokens == 0 and alone.n_known == 0 and math.isfinite(alone.score) and alone.base_score == 0.0


def test_exchange_finds_the_classes():
    table = np.zeros((8, 8), np.int64)
    table[:3, 3:] = 10
    table[3:, :3] = 10
    own = exchange(table, 8, 2)
    assert len(set(own[:3])) == 1 and len(set(own[3:])) == 1 and own[0] != own[3]


def test_words_beyond_the_exchanged_ones_get_the_class_of_their_neighbours(spark, monkeypatch):
    from lexispark.llm import lm

    monkeypatch.setattr(lm, "CLUSTERED", 21)
    monkeypatch.setattr(lm, "CLASSES", 4)
    rng = np.random.default_rng(7)
    # ten frequent words of each kind alternate; the rare ones stand where their kind stands
    word = lambda kind: f"{kind}{rng.integers(10)}" if rng.random() < 0.8 else f"{kind}rare{rng.integers(200)}"
    rows = [(i, " ".join(word(k) for _ in range(20) for k in "nv")) for i in range(300)]
    rows += [(1000 + i, t) for i, t in enumerate(["n1 vrare5", "n1 nrare5"] * 40)]
    docs = spark.createDataFrame([r for r in rows if r[0] < 1000 or zlib.crc32(str(r[0]).encode()) % 7 == 2], "doc_id long, text string")
    text = dict(rows)
    got = {text[r.doc_id]: r for r in lm_scores(docs).collect() if r.doc_id >= 1000}
    right, wrong = got["n1 vrare5"], got["n1 nrare5"]
    assert right.score - right.base_score > wrong.score - wrong.base_score + 0.5
    few = {text[r.doc_id]: r for r in lm_scores(docs, head_words=5).collect() if r.doc_id >= 1000}
    assert all(abs(few[t].score - got[t].score) < 1e-9 for t in got)
