"""Exact top-k inner products by pivot-table elimination.

Vectors become integers (floor of a multiple). A table holds what each vector's distances to the pivots and to the origin say
of it: its coordinates in the pivots' span, in an orthogonal frame, and the length of what lies outside. The distance of two such
rows is the largest lower bound of the vectors' distance that all these distances together allow (a single pivot's difference,
as in the triangle inequality, is never larger), so their product is an upper bound of the inner product.

Each query first meets a bounded sample, the one from which the pivots were picked: its k-th best score there is a floor that it carries to
every block. In a block of candidates those whose bound is below the floor are eliminated unseen; the others are evaluated in the order of the
bound, until the next bound is below the k-th best score: the result is exact. Blocks of queries and of candidates have
a bounded size; a query's best of all blocks are merged by a limited rank.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexispark.llm.common import hash63, width, written

PIVOTS, SAMPLE, QUERY_BLOCK, ROW_BLOCK, CHUNK = 56, 512, 8192, 16_384, 128
_LEAST_ROWS = 1024
_LONG = 2**63
_STEP = 256


def _pick(sample: np.ndarray, count: int) -> np.ndarray:
    """Pivots far from each other: the next one is the vector of the sample farthest from those chosen."""
    if not len(sample):
        return sample
    chosen = [0]
    near = ((sample - sample[0]) ** 2).sum(axis=1)
    while len(chosen) < min(count, len(sample)):
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


def _largest(x: np.ndarray) -> np.ndarray:
    """The largest component of each row, at least the smallest number above 0."""
    return np.maximum(np.abs(x).max(axis=1, keepdims=True, initial=0.0), np.finfo(float).tiny)


def frame(sample: np.ndarray, count: int) -> np.ndarray:
    """Orthonormal columns that span the pivots."""
    pivots = _pick(sample / max(1.0, float(np.abs(sample).max(initial=0.0))), count)
    # only their directions count
    return np.linalg.qr((pivots / _largest(pivots)).T)[0] if pivots.size else np.zeros((sample.shape[1], 0))


def pivot_rows(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Coordinates in the pivots' span, then the length of the rest: products of two rows bound the vectors' product from above."""
    most = _largest(x)
    y = x / most  # squares of large numbers would be beyond doubles
    inside = y @ q
    rest = np.maximum(0.0, (y**2).sum(axis=1) - (inside**2).sum(axis=1))
    return np.c_[inside, np.sqrt(rest)] * most


def _matrix(blobs: pd.Series, columns: int) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.float64).reshape(len(blobs), columns) if columns else np.zeros((len(blobs), 0))


def _products(c: np.ndarray, q: np.ndarray, most: float) -> list[int] | np.ndarray:
    """Exact inner products of whole numbers kept as doubles; ``most`` bounds their size."""
    if most < 2**52:
        return (c @ q).astype(np.int64)
    if most < 2**62:
        return c.astype(np.int64) @ q.astype(np.int64)
    whole = [int(y) for y in q]
    return np.array([sum(int(x) * y for x, y in zip(row, whole, strict=True)) for row in c], object)


def _near(score: int) -> float:
    return float(score) if abs(score) < 2**1023 else float(np.finfo(float).max) * (-1 if score < 0 else 1)


@np.errstate(over="ignore", invalid="ignore")
def _best(q: np.ndarray, pq: np.ndarray, floor: np.ndarray, qid: np.ndarray, c: np.ndarray, pc: np.ndarray, cid: np.ndarray, k: int) -> tuple[list, list, list, int]:
    """For each query its k best of the candidates not below its floor (fewer if there are fewer), and how many were evaluated."""
    high = np.abs(c).max(axis=1, initial=0.0)
    nq, nc = (q**2).sum(axis=1), (c**2).sum(axis=1)
    ids, to, scores, seen = [], [], [], 0
    for at in range(0, len(q), _STEP):
        bounds = pq[at : at + _STEP] @ pc.T
        if not np.isfinite(bounds).all():
            bounds[~np.isfinite(bounds)] = np.inf  # beyond doubles: nothing is eliminated
        for i, bound in enumerate(bounds, at):
            bound += 1e-9 * (nq[i] + nc) + 1.0  # rounding of the table
            bound[cid == qid[i]] = -np.inf
            left = np.flatnonzero(bound >= floor[i])
            left = left[np.argsort(-bound[left], kind="stable")]
            got_s, got_v = np.zeros(0, np.int64), np.zeros(0, np.int64)
            peak = float(np.abs(q[i]).max(initial=0.0)) * q.shape[1]
            for s in range(0, len(left), CHUNK):
                part = left[s : s + CHUNK]
                if len(got_s) == k and bound[part[0]] < got_s[-1]:
                    break
                seen += len(part)
                got_s = np.concatenate([got_s, _products(c[part], q[i], peak * float(high[part].max()))])
                got_v = np.concatenate([got_v, cid[part]])
                top = np.array(sorted(range(len(got_s)), key=lambda j: (-got_s[j], got_v[j]))[:k]) if got_s.dtype == object else np.lexsort((got_v, -got_s))[:k]
                got_s, got_v = got_s[top], got_v[top]
            ids += [int(qid[i])] * len(got_s)
            to += got_v.tolist()
            scores += [int(x) for x in got_s]
    return ids, to, scores, seen


def exact_topk(vectors: DataFrame, k: int = 10, every: int = 100, scale: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding", pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by ``every`` its k best other rows.

    Ties go to the smaller vec_id. Vectors that are null or hold null, NaN or infinite components, and rows without
    an id, take no part; shorter vectors count as filled up with zeros, empty ones as zero. Rows repeated with one id are one query (if their
    vectors differ, the smallest of them), and no candidates of their own query. Fewer than k candidates: all of them.
    Scores beyond the range of a long are ranked by the nearest doubles and given as its ends; a component whose multiple is beyond a double
    counts as infinite. Empty table: no rows. Other columns are ignored.
    """
    e = F.col("__v")
    spark = vectors.sparkSession
    src = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("__v"))
    # floors of doubles are doubles, and a power of two changes no digits
    src = src.withColumn("__v", F.transform("__v", lambda x: x * F.lit(float(scale))))
    fit = src.where(F.col("vec_id").isNotNull() & e.isNotNull() & ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    first = fit.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()  # a bounded sample, for the pivots and the floors only
    size = fit.agg(F.max(F.size(e))).first()[0] or 0

    def whole(rows: list) -> np.ndarray:
        out = np.zeros((len(rows), size))
        for i, v in enumerate(rows):
            out[i, : len(v)] = np.floor(np.asarray(v, float))
        return out

    sample, sample_ids = whole([r["__v"] for r in first]), np.array([r["vec_id"] for r in first], np.int64)
    axes = frame(sample, pivots)
    lowest = float(np.finfo(float).min)

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            m, ids = whole(b["__v"].tolist()), b["vec_id"].to_numpy()
            floor = np.full(len(b), lowest)
            for i in np.flatnonzero(ids % every == 0):
                others = sample[sample_ids != ids[i]]
                if len(others) >= k:
                    with np.errstate(over="ignore", invalid="ignore"):
                        low = np.sort(others @ m[i])[-k] - 1e-9 * float((m[i] ** 2).sum() + (others**2).sum(axis=1).max()) - 1.0
                    floor[i] = low if np.isfinite(low) else lowest
            yield pd.DataFrame({"vec_id": ids, "v": [r.tobytes() for r in m], "p": [r.tobytes() for r in pivot_rows(m, axes)], "floor": floor})

    table = written(fit.mapInPandas(measured, "vec_id long, v binary, p binary, floor double"), "pivots")
    asked = F.col("vec_id") % every == 0
    rows, queries = table.agg(F.count(F.lit(1)), F.sum(asked.cast("long"))).first()
    # blocks as large as memory allows, for each is copied once for every block of the other side; smaller ones only to keep all cores busy
    blocks = max(1, -(-rows // ROW_BLOCK), min(-(-rows // _LEAST_ROWS), 2 * width(spark)))
    turns = max(1, -(-(queries or 0) // QUERY_BLOCK))
    span = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = table.drop("floor").withColumn("cut", F.pmod(hash63(F.col("vec_id"), F.lit(1)), F.lit(blocks)).cast("int")).withColumn("turn", span(turns))
    right = table.where(asked).groupBy("vec_id").agg(F.min(F.struct("v", "p", "floor")).alias("s")).select("vec_id", "s.*")
    right = right.withColumn("turn", F.pmod(hash63(F.col("vec_id"), F.lit(2)), F.lit(turns)).cast("int")).withColumn("cut", span(blocks))
    wide = axes.shape[1] + 1

    def search(c: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(c) or not len(q):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": [], "order": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "int64", "order": "float64"})
        ids, to, scores, _ = _best(_matrix(q["v"], size), _matrix(q["p"], wide), q["floor"].to_numpy(), q["vec_id"].to_numpy(), _matrix(c["v"], size), _matrix(c["p"], wide), c["vec_id"].to_numpy(), k)
        fits = [min(max(s, -_LONG), _LONG - 1) for s in scores]
        return pd.DataFrame({"query_id": np.array(ids, np.int64), "vec_id": np.array(to, np.int64), "score": np.array(fits, np.int64), "order": np.array([_near(s) for s in scores], float)})

    found = left.groupBy("cut", "turn").cogroup(right.groupBy("cut", "turn")).applyInPandas(search, "query_id long, vec_id long, score long, order double")
    # the double only tells scores apart that a long cannot hold; of two that it can, the larger long never has the smaller double
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("order"), F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
