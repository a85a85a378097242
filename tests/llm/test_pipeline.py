from collections import Counter

import numpy as np
import pytest

import corpus_pipeline as cp
from lexispark.llm.bpe import BPE, default_path
from tests.llm.test_minhash import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(9)
    word = lambda: f"w{rng.integers(0, 3000)}"
    rows, labels = [], []
    for i in range(400):
        words = [word() for _ in range(int(rng.integers(20, 60)))]
        if i % 5 == 0:
            words += ["vilescum", "badword"]
            rng.shuffle(words)
        rows.append([i, " ".join(words)])
        labels.append((i, int(i % 5 == 0)))
    rows += [[1000 + k, rows[3][1].upper() if k % 2 else rows[3][1]] for k in range(20)]
    rows += [[2000 + k, rows[7][1] + f" tail{k}"] for k in range(10)]
    rows += [[3000, None], [3001, ""], [3002, "one"]]
    return [(i, t, "en", f"s{i % 3}" if i != 11 else None, len(t or "")) for i, t in rows], labels


def test_stages_against_brute_force(spark, data, tmp_path):
    rows, labels = data
    sf = f"file://{tmp_path}/sf"
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{sf}/labels.parquet")
    toxic = {i for i, y in labels if y}
    left = {r[0]: r for r in rows if r[0] not in toxic}
    best = {}
    for i, r in left.items():
        key = (r[1] or "").encode().lower()
        best[key] = max(best.get(key, i), i)
    exact = set(best.values())
    near = {i for i, (_, c) in brute([(i, left[i][1]) for i in sorted(exact)]).items() if c == i}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = []
    for k, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, sf)
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append(docs.collect())
    assert {r.doc_id for r in seen[0]} == set(left) and len(seen[0]) == len(left)
    assert Counter(r.doc_id for r in seen[1]) == Counter(exact)
    assert Counter(r.doc_id for r in seen[2]) == Counter(near)
    assert all(tuple(r) == left[r.doc_id] for r in seen[2])
    taken = Counter(r.doc_id for r in seen[3])
    assert set(taken) <= near and max(taken.values()) <= 3
    size = {i: len((left[i][1] or "").split()) for i in near}
    assert sum(size[i] * n for i, n in taken.items()) == pytest.approx(sum(size.values()), rel=0.02)
    bpe = BPE(default_path())
    assert Counter(r.doc_id for r in seen[4]) == taken
    for r in seen[4]:
        assert list(r.ids) == np.frombuffer(bpe.encode(left[r.doc_id][1] or ""), "<u4").tolist() and r.n_tokens == len(r.ids)


def test_repeated_and_missing_identifiers(spark):
    one, two, three = (" ".join(f"{k}{i}" for i in range(30)) for k in "abc")
    near = one + " tail"
    rows = [(5, one), (5, two), (9, two), (9, two.upper()), (None, two), (None, two), (3, near), (5, one), (7, three), (None, None), (8, ""), (2, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, 0.5) for i, t in rows], SCHEMA + ", score double")
    key = lambda r: (r.doc_id, (r.text or "").lower())
    exact = cp.drop_exact_copies(spark, docs, "")
    assert exact.columns == docs.columns
    # 5's text "two" goes, its text "one" has no copy with a larger identifier; 9 stays once
    want = Counter([(5, one), (9, two), (None, two), (None, two), (3, near), (7, three), (None, ""), (8, "")])
    got = exact.collect()
    assert Counter(map(key, got)) == want
    left = cp.drop_near_copies(spark, exact, "")
    assert left.columns == docs.columns
    want -= Counter([(5, one)])  # near 3's text
    assert Counter(map(key, left.collect())) == want
    source = lambda i: "a" if i % 4 else "b"
    many = [(i % 50 if i % 3 else None, " ".join(["w"] * (1 + i % 7)), "en", source(i), i, 0.5) for i in range(600)]
    mixed = cp.mix(spark, spark.createDataFrame(many, SCHEMA + ", score double"), "")
    taken, size = Counter(), Counter()
    for r in mixed.collect():
        taken[r.source] += len(r.text.split())
        assert source(r.n_chars) == r.source
    for _, t, _, s, *_ in many:
        size[s] += len(t.split())
    share = sum(size.values()) / 3
    want = {"b": min(2 * share, 3 * size["b"])}
    want["a"] = sum(size.values()) - want["b"]
    assert all(abs(taken[s] - want[s]) <= max(2, 0.001 * want[s]) for s in want)


def test_empty_documents(spark, tmp_path):
    sf = f"file://{tmp_path}/sf"
    spark.createDataFrame([], SCHEMA).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{sf}/labels.parquet")
    assert cp.run(spark, sf).collect() == []
