"""Centroid clustering (Lloyd's rounds) filtered by partition-local ball trees.

Vectors become integers once and are kept in blocks: each block, made from the rows of one partition, holds its vectors in the order
of a ball tree, and for each ball its range, its radius, its count and the integer sum of its vectors. A round takes all balls of a block
level by level: a centroid is struck out for a ball if another one is nearer to every vector within it, by the triangle inequality or its sharper form for squared distances; a ball that
has one centroid left is assigned whole, with its count and sum; the rest go down to the leaves, where exact integer distances to
the centroids left decide. Each task adds up its blocks and sends k x d sums, as digits of a large base, so that sums are exact whatever the
number of vectors; the driver sees those k x d figures and nothing else. A table's blocks are written once and read by every round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.llm.common import written

BLOCK, LEAF = 2048, 32
BASE = 1 << 40
_LONG = 2**63
_BLOCKS = "n long, width int, ids binary, vectors binary, balls binary, sums binary"
_BALL = np.dtype([("lo", "<i4"), ("hi", "<i4"), ("left", "<i4"), ("right", "<i4"), ("radius", "<f8")])


def safe(width: int) -> float:
    """Components below this give squared distances that are whole numbers within a double."""
    return (2.0**51 / max(1, width)) ** 0.5


def ball_tree(x: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the vectors, balls (range, children or -1, radius) parents first, and the sum of each ball's vectors.

    A ball is cut at the median of its vectors' places on the line between two far ones; balls of equal vectors are not cut.
    """
    order = np.arange(len(x))
    balls, sums = [], []
    todo = [(0, len(x), -1)]
    while todo:
        lo, hi, parent = todo.pop()
        rows = x[order[lo:hi]]
        total = rows.sum(axis=0)
        away = np.sqrt(((rows - total / len(rows)) ** 2).sum(axis=1))
        me = len(balls)
        balls.append([lo, hi, -1, -1, float(away.max())])
        sums.append(total)
        if parent >= 0:
            balls[parent][2 if balls[parent][2] < 0 else 3] = me
        if hi - lo <= leaf or not away.max() > 1e-9:
            continue
        one = rows[away.argmax()]
        other = rows[((rows - one) ** 2).sum(axis=1).argmax()]
        order[lo:hi] = order[lo:hi][np.argsort(rows @ (other - one), kind="stable")]
        mid = (lo + hi) // 2
        todo += [(mid, hi, me), (lo, mid, me)]
    return order, np.array([tuple(b) for b in balls], _BALL), np.array(sums)


def _exact(x: np.ndarray, c: list[list[int]], most: float) -> np.ndarray:
    """Squared distances as whole numbers: rows x centroids. ``most`` bounds the components."""
    if most < safe(x.shape[1]):
        m = np.array(c, float)
        return (x**2).sum(axis=1)[:, None] - 2 * (x @ m.T) + (m**2).sum(axis=1)
    rows = [[int(v) for v in r] for r in x]
    out = np.empty((len(rows), len(c)), object)
    for i, r in enumerate(rows):
        for j, m in enumerate(c):
            out[i, j] = sum((a - b) ** 2 for a, b in zip(r, m, strict=True))
    return out


class Block:
    """Vectors of one block with their balls."""

    def __init__(self, x: np.ndarray, balls: np.ndarray, sums: np.ndarray):
        self.x, self.balls, self.sums = x, balls, sums
        self.high = float(np.abs(x).max(initial=0.0))

    def assign(self, centroids: list[list[int]]) -> tuple[np.ndarray, list[tuple[int, int, np.ndarray]], np.ndarray, int]:
        """Centroid of every vector, the whole balls assigned (centroid, count, sum), the vectors decided one by one, and how many distances were computed.

        Ties go to the smaller number.
        """
        k = len(centroids)
        most = max(self.high, _largest(centroids))
        label = np.full(len(self.x), -1)
        whole: list[tuple[int, int, np.ndarray]] = []
        # leaves that are open, with the centroids that are left to them
        leaves: list[tuple[int, int, np.ndarray]] = []
        seen = 0
        if most >= safe(self.x.shape[1]):
            leaves.append((0, len(self.x), np.ones(k, bool)))
        else:
            m = np.array(centroids, float)
            apart = np.sqrt(np.maximum(0.0, ((m[:, None] - m[None]) ** 2).sum(axis=2)))
            level, open_ = np.array([0]), np.ones((1, k), bool)
            while len(level):
                b = self.balls[level]
                middle = self.sums[level] / (b["hi"] - b["lo"])[:, None]
                far = np.sqrt(np.maximum(0.0, (middle**2).sum(axis=1)[:, None] - 2 * (middle @ m.T) + (m**2).sum(axis=1)))
                seen += int(open_.sum())
                far[~open_] = np.inf
                # the farthest that a vector of the ball is from the nearest centroid, against the nearest it can be to another; a margin for rounding
                near = far.min(axis=1)
                keep = far - b["radius"][:, None] <= ((near + b["radius"]) * (1 + 1e-9) + 1e-3)[:, None]
                # and the sharper one for two centroids: their squared distances differ over the ball by twice its radius times their own distance at most
                keep &= far**2 - (near**2)[:, None] <= 2 * b["radius"][:, None] * apart[far.argmin(axis=1)] * (1 + 1e-9) + 1e-3
                open_ &= keep
                decided = open_.sum(axis=1) == 1
                for i in np.flatnonzero(decided):
                    c = int(open_[i].argmax())
                    whole.append((c, int(b["hi"][i] - b["lo"][i]), self.sums[level[i]]))
                    label[b["lo"][i] : b["hi"][i]] = c
                inner = ~decided & (b["left"] >= 0)
                leaves += [(int(b["lo"][i]), int(b["hi"][i]), open_[i]) for i in np.flatnonzero(~decided & (b["left"] < 0))]
                level = np.concatenate([b["left"][inner], b["right"][inner]])
                open_ = np.concatenate([open_[inner], open_[inner]])
        rows = np.concatenate([np.arange(lo, hi) for lo, hi, _ in leaves]) if leaves else np.zeros(0, np.int64)
        if leaves:
            left = np.repeat(np.array([o for *_, o in leaves]), [hi - lo for lo, hi, _ in leaves], axis=0)
            some = np.flatnonzero(left.any(axis=0))
            d = _exact(self.x[rows], [centroids[j] for j in some], most)
            seen += int(left.sum())
            if d.dtype == object:
                label[rows] = some[[min(range(len(some)), key=lambda j: (r[j], j)) for r in d]]
            else:
                d[~left[:, some]] = np.inf
                label[rows] = some[d.argmin(axis=1)]
        return label, whole, rows, seen

    def totals(self, centroids: list[list[int]]) -> dict[int, list[int]]:
        """Count and exact component sums of the vectors of each centroid."""
        label, whole, rows, _ = self.assign(centroids)
        out: dict[int, list[int]] = {}
        for c, n, s in whole:
            _add(out, c, n, [int(v) for v in s])
        for c in np.unique(label[rows]):
            x = self.x[rows[label[rows] == c]]
            s = x.sum(axis=0).tolist() if self.high < safe(x.shape[1]) else [sum(map(int, col)) for col in x.T]
            _add(out, int(c), len(x), [int(v) for v in s])
        return out


def _largest(centroids: list[list[int]]) -> float:
    return float(min(max((abs(v) for c in centroids for v in c), default=0), 10**300))


def _add(to: dict[int, list[int]], c: int, n: int, s: list[int]) -> None:
    have = to.setdefault(c, [0] * (len(s) + 1))
    have[0] += n
    for i, v in enumerate(s, 1):
        have[i] += v


def _stored(ids: list, x: np.ndarray) -> dict:
    high = float(np.abs(x).max(initial=0.0))
    order, balls, sums = ball_tree(x) if high < safe(x.shape[1]) else (np.arange(len(x)), np.zeros(0, _BALL), np.zeros((0, x.shape[1])))
    kind = "<f4" if high < 2.0**24 else "<f8"
    named = np.array([0 if i is None else i for i in ids], "<i8")[order]
    known = np.array([i is not None for i in ids], "u1")[order]
    return {"n": len(x), "width": x.shape[1], "ids": named.tobytes() + known.tobytes(), "vectors": kind.encode() + x[order].astype(kind).tobytes(), "balls": balls.tobytes(), "sums": sums.astype("<f8").tobytes()}


def _loaded(r) -> tuple[list[int | None], Block]:
    named, known = np.frombuffer(r.ids, "<i8", r.n), np.frombuffer(r.ids, "u1", r.n, 8 * r.n)
    x = np.frombuffer(r.vectors, r.vectors[:3].decode(), offset=3).reshape(r.n, r.width).astype(float)
    balls, sums = np.frombuffer(r.balls, _BALL), np.frombuffer(r.sums, "<f8").reshape(-1, r.width)
    return [int(i) if k else None for i, k in zip(named, known, strict=True)], Block(x, balls, sums)


def _blocks(width: int, size: int):
    """Blocks of the rows of one partition; vectors too large for exact doubles lie in blocks of their own, without balls."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[bool, tuple[list, list]] = {False: ([], []), True: ([], [])}
        for b in batches:
            if not len(b):
                continue
            x = np.floor(np.stack(b["v"].to_numpy())).reshape(len(b), width)
            ids = [None if pd.isna(i) else int(i) for i in b["vec_id"]]
            wide = np.abs(x).max(axis=1, initial=0.0) >= safe(width)
            for i, large in enumerate(wide.tolist()):
                named, rows = held[large]
                named.append(ids[i])
                rows.append(x[i])
                if len(named) == size:
                    yield pd.DataFrame([_stored(named, np.array(rows))])
                    named.clear()
                    rows.clear()
        for named, rows in held.values():
            if named:
                yield pd.DataFrame([_stored(named, np.array(rows))])

    return run


def _digits(v: int) -> Iterator[tuple[int, int]]:
    """Places and digits of a whole number in the base, with its sign."""
    sign, v, at = (-1, -v, 0) if v < 0 else (1, v, 0)
    while v:
        v, low = divmod(v, BASE)
        if low:
            yield at, sign * low
        at += 1


def clustered(vectors: DataFrame, k: int = 16, rounds: int = 3, scale: int = 64, width: int = 64, id_col: str = "vec_id", vec_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector with ``width`` finite components.

    Components become floor(scale * x), exactly, however large. Centroids start as the k vectors with the smallest SHA-256 of ``1:<vec_id>``
    (fewer vectors: all of them; equal identifiers: by their components; rows without an identifier come last and are
    assigned like all others). Ties go to the smaller centroid; an empty centroid stays; repeated rows count as often as they occur. Distances and
    sums beyond a long are given as its largest value. Nothing kept, or an empty table: no rows. Other columns are ignored.
    """
    e = F.col("__v")
    spark = vectors.sparkSession
    src = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(F.col(vec_col).cast("array<double>"), lambda x: x * F.lit(float(scale))).alias("__v"))
    fit = src.where(e.isNotNull() & (F.size(e) == width) & ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    first = fit.orderBy(F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256).asc_nulls_last(), e).limit(k).collect()  # k rows
    centroids = [[int(np.floor(v)) for v in r["__v"]] for r in first]
    table = written(fit.select("vec_id", e.alias("v")).mapInPandas(_blocks(width, block), _BLOCKS), "balls")

    def added(now: list[list[int]]):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total: dict[int, list[int]] = {}
            for b in batches:
                for r in b.itertuples():
                    for c, s in _loaded(r)[1].totals(now).items():
                        _add(total, c, s[0], s[1:])
            rows = [(c, i, at, d) for c, s in total.items() for i, v in enumerate(s) for at, d in _digits(v)]
            yield pd.DataFrame(rows, columns=["cluster", "place", "digit", "value"]).astype("int64")

        return run

    for _ in range(rounds if centroids else 0):
        got = table.mapInPandas(added(centroids), "cluster long, place long, digit long, value long").groupBy("cluster", "place", "digit").agg(F.sum("value").alias("value"))
        sums = [[0] * (width + 1) for _ in centroids]
        for r in got.collect():  # k x (width + 1) numbers
            sums[r.cluster][r.place] += r.value * BASE**r.digit
        centroids = [[v // s[0] for v in s[1:]] if s[0] else c for c, s in zip(centroids, sums, strict=True)]
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]

    def last(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                ids, blk = _loaded(r)
                label, *_ = blk.assign(centroids)
                own = np.empty(r.n, np.int64)
                for c in np.unique(label):
                    at = np.flatnonzero(label == c)
                    d = _exact(blk.x[at], [centroids[c]], max(blk.high, _largest([centroids[c]])))[:, 0]
                    own[at] = [min(int(v), _LONG - 1) for v in d]
                yield pd.DataFrame({"vec_id": pd.array(ids, "Int64"), "cluster": label.astype("int32"), "distance": own})

    out = written(table.mapInPandas(last, "vec_id long, cluster int, distance long"), "assigned")
    clip = lambda c: F.least(c, F.lit(_LONG - 1).cast("decimal(38,0)")).cast("long")
    per = out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()  # k rows
    whole = spark.createDataFrame([(r.cluster, r.s, sum(x.s for x in per), digests[r.cluster]) for r in per], "cluster int, own decimal(38,0), every decimal(38,0), centroid_sha256 string")
    return out.join(F.broadcast(whole), "cluster").select("vec_id", "cluster", "distance", clip(F.col("own")).alias("cluster_inertia"), clip(F.col("every")).alias("inertia"), "centroid_sha256")
