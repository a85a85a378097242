import random

import numpy as np
from pyspark.sql import functions as F

from lexispark.operators import incidence, products, structure
from lexispark.session import written


def _matrix(rnd, docs, k, share):
    m = np.array([[rnd.random() < share * (1 + 5 * (j < 3)) for j in range(k)] for _ in range(docs)])
    return m.astype(np.int64)


def _incidence(spark, matrices):
    rows = [(lang, d, j) for lang, m in matrices.items() for d, j in zip(*(x.tolist() for x in np.nonzero(m)))]
    return spark.createDataFrame(rows, "lang string, doc_id long, rank long")


def test_blocks_equal_dense_products(spark):
    rnd = random.Random(4)
    # a side of 7 cuts 23 keywords unevenly; one language fills a single block, one has no name
    matrices = {"a": _matrix(rnd, 70, 23, 0.15), "b": _matrix(rnd, 30, 5, 0.4), None: _matrix(rnd, 40, 16, 0.3)}
    inc = _incidence(spark, matrices)
    blocks = written(products.cooccurrence_blocks(inc.repartition(7), 7), "blocks")
    got = {(r.lang, r.i, r.j): r.n for r in products.pairs_of_blocks(blocks, 7).collect()}
    want, dots, cosines = {}, {}, {}
    for lang, m in matrices.items():
        c = m.T @ m
        np.fill_diagonal(c, 0)
        p = c @ c
        norm = np.sqrt(np.diag(p))
        for i in range(len(c)):
            for j in range(i, len(c)):
                if c[i, j]:
                    want[lang, i, j] = c[i, j]
                if p[i, j]:
                    dots[lang, i, j] = p[i, j]
                    if i < j:
                        cosines[lang, i, j] = p[i, j] / (norm[i] * norm[j])
    assert got == want
    dot = written(products.profile_products(blocks, 7), "dots")
    assert {(r.lang, r.i, r.j): r.dot for r in dot.collect()} == dots
    cos = {(r.lang, r.i, r.j): r.cosine for r in products.profile_cosine(dot).collect()}
    assert cos.keys() == cosines.keys() and all(abs(cos[x] - cosines[x]) < 1e-12 for x in cos)


def test_blocks_with_small_bounds(spark, monkeypatch):
    # tasks send their blocks many times, and documents of more pairs than are made at a time stand alone
    monkeypatch.setattr(products, "PAIRS", 20)
    monkeypatch.setattr(products, "HELD", 3 * 16 * 8)
    m = _matrix(random.Random(9), 50, 18, 0.3)
    m[3] = 1
    inc = _incidence(spark, {"a": m})
    want = {(r.i, r.j): r.n for r in structure.cooccurrence(inc).collect()}
    assert {(r.i, r.j): r.n for r in products.pairs_of_blocks(products.cooccurrence_blocks(inc, 4), 4).collect()} == want


def test_blocks_of_odd_incidences(spark):
    schema = "lang string, doc_id long, rank long"
    for rows, want in (
        ([], []),
        ([("a", 1, 0), ("a", 2, 1)], []),  # no two keywords meet
        ([("a", 1, 0), ("a", 1, 0), ("a", 1, 300), ("a", None, 1), ("a", 1, None), (None, 1, 5)], [("a", 0, 300, 1)]),
    ):
        blocks = written(products.cooccurrence_blocks(spark.createDataFrame(rows, schema)), "blocks")
        assert [tuple(r) for r in products.pairs_of_blocks(blocks).collect()] == want
        assert products.profile_products(blocks).where(F.col("i") == F.col("j")).count() == 2 * len(want)


def test_pairs_of_lists():
    i, j = products.document_pairs([np.array([2, 5, 9]), np.array([4]), np.array([0, 1])])
    assert list(zip(i.tolist(), j.tolist())) == [(2, 5), (2, 9), (5, 9), (0, 1)]
    assert [len(x) for x in products.document_pairs([])] == [0, 0]
    assert [s.stop - s.start for s in products._runs(np.array([1, 2, 9, 1, 1, 3]), 4)] == [2, 1, 2, 1]


def test_documents_of_many_keywords_are_multiplied_as_rows():
    rnd = np.random.default_rng(5)
    lists = [np.flatnonzero(rnd.random(40) < share) for share in (0.9, 0.5, 0.1, 1.0, 0.02) for _ in range(30)]
    lists = [x for x in lists if len(x) > 1]
    by_pairs = {(bi, bj): np.bincount(cells, minlength=256) for bi, bj, cells in products._cells(*products.document_pairs(lists), 16)}
    by_rows = {(bi, bj): n for bi, bj, n in products._dense(lists, 16)}
    assert by_pairs.keys() == by_rows.keys() and all((by_pairs[k] == by_rows[k]).all() for k in by_pairs)


def test_keyword_lists_are_the_grouped_incidence(spark):
    rnd = random.Random(6)
    words = [f"w{i}" for i in range(30)] + ["é", "Z"]
    rows = [(None if i % 41 == 0 else i // (1 + (i % 17 == 0)), rnd.choice(["en", "fr", "xx", None]), None if i % 53 == 0 else rnd.sample(words, rnd.randrange(9))) for i in range(300)]
    tok = spark.createDataFrame(rows, "doc_id long, lang string, tokens array<string>").repartition(5)
    kw = incidence.top_keywords(tok.where("lang is null or lang <> 'xx'"), 12)
    sets = incidence.incidence(tok, kw).where("doc_id is not null").groupBy("lang", "doc_id").agg(F.sort_array(F.collect_set("rank")).alias("r"))
    got = incidence.keyword_lists(tok, kw)
    assert sorted(map(str, got.collect())) == sorted(map(str, sets.collect())) and got.count() > 100
    assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()  # no row for each keyword of a document
