import hashlib
import math
from collections import Counter

import numpy as np

from lexispark.llm.centroids import Block, ball_tree, clustered

SCHEMA = "vec_id long, embedding array<double>, cluster string, n int"


def lloyd(rows, k, rounds, width, scale=64):
    """Plain rounds over Python integers."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centroids = [v for _, v in order[:k]]
    for step in range(rounds + 1):
        near = [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids)) for _, v in kept]
        if step == rounds:
            break
        for j in range(len(centroids)):
            own = [v for (_, v), (_, c) in zip(kept, near, strict=True) if c == j]
            if own:
                centroids[j] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    cap = lambda x: min(x, 2**63 - 1)
    per = Counter()
    for d, j in near:
        per[j] += cap(d)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return Counter((i, j, cap(d), cap(per[j]), cap(sum(per.values())), digest[j]) for (i, _), (d, j) in zip(kept, near, strict=True))


def as_rows(df):
    return Counter((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect())


def test_against_plain_rounds(spark):
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(9, 6)) * 4
    rows = [(i, [float(x) for x in middles[i % 9] + rng.normal(size=6) * 0.2]) for i in range(700)]
    rows += [(i, [1.0, -1.0, 0.5, 0.25, 0.0, 3.0]) for i in range(700, 1000)] + [(5, rows[5][1]), (None, [0.1] * 6), (None, [0.1] * 6)]
    rows += [(2000, None), (2001, [1.0] * 5), (2002, [1.0] * 7), (2003, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (2004, [float("nan")] * 6), (2005, [float("inf")] + [0.0] * 5), (2006, [])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA).repartition(5)
    assert as_rows(clustered(df, k=8, rounds=3, width=6, block=128)) == lloyd(rows, 8, 3, 6)


def test_ties_and_few_and_large_vectors(spark):
    rows = [(i, [float(i % 3), 0.0]) for i in range(40)] + [(100, [0.5, 0.0])]
    assert as_rows(clustered(spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA), k=4, width=2)) == lloyd(rows, 4, 3, 2)
    few = [(1, [1.0, 2.0]), (2, [3.0, 4.0])]
    assert as_rows(clustered(spark.createDataFrame([(i, v, "x", 1) for i, v in few], SCHEMA), k=4, width=2)) == lloyd(few, 4, 3, 2)
    wide = few + [(i, [i * 1e7, -3.0]) for i in range(3, 9)] + [(20, [1e30, 0.0]), (21, [-1e30, 5.0]), (22, [1e200, 1e200])]
    assert as_rows(clustered(spark.createDataFrame([(i, v, "x", 1) for i, v in wide], SCHEMA), k=3, width=2)) == lloyd(wide, 3, 3, 2)


def test_empty(spark):
    for rows in ([], [(1, None, "x", 1), (2, [1.0], "x", 1)]):
        assert clustered(spark.createDataFrame(rows, SCHEMA), width=2).collect() == []


def test_balls_hold_their_vectors_and_save_distances():
    rng = np.random.default_rng(8)
    middles = rng.integers(-400, 400, (12, 5))
    x = np.floor(np.concatenate([m + rng.normal(size=(150, 5)) * 6 for m in middles]))
    order, balls, sums = ball_tree(x, leaf=16)
    y = x[order]
    assert sorted(order.tolist()) == list(range(len(x)))
    for b, s in zip(balls, sums, strict=True):
        own = y[b["lo"] : b["hi"]]
        assert (own.sum(axis=0) == s).all()
        assert np.sqrt(((own - s / len(own)) ** 2).sum(axis=1)).max() <= b["radius"] + 1e-9
        if b["left"] >= 0:
            l, r = balls[b["left"]], balls[b["right"]]
            assert (l["lo"], l["hi"], r["hi"]) == (b["lo"], r["lo"], b["hi"])
    centroids = [[int(v) for v in m] for m in middles]
    label, whole, rows, seen = Block(y, balls, sums).assign(centroids)
    d = ((y[:, None] - middles[None]) ** 2).sum(axis=2)
    assert (label == d.argmin(axis=1)).all()
    # grouped vectors go as whole balls: far fewer distances than vectors times centroids
    assert sum(n for _, n, _ in whole) > 0.9 * len(x) and seen < 0.2 * d.size
    got = Block(y, balls, sums).totals(centroids)
    assert all(got[c] == [int((label == c).sum()), *map(int, y[label == c].sum(axis=0))] for c in got)
