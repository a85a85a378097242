"""Mixing sources to target weights by the cube method of balanced sampling.

A document of a source with target t and size s (words) is wanted t / s times: the whole part of that ratio as whole
copies, its fraction as an inclusion probability. The flight phase moves these probabilities through the null space
of the balancing constraints until all but a few in a block are 0 or 1. Documents much larger than most of their block go first: one
such is drawn, and all smaller ones move against it, so that the number of words stays (steps of three documents would leave it
open to the end, when nothing could make up for it); where probabilities alone cannot, the smaller ones gain or lose a whole copy. The others move by threes
and keep both the number of documents and of words. What is left of the blocks of a source, and twelve documents that each
keeps back, of sizes that halve step by step, meets in new blocks, and so on, until one block remains. There these are the landing problem: the best
of their roundings is taken. Where a source has several blocks, documents too large for the others of one block to make up for are drawn
before all others, and the rest of the target goes to the rest of the source. Blocks have a bounded size, whatever
the size of a source, and all draws come from a seeded hash, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexispark.llm.common import hash63, small_batches, written

BLOCK = 4096
RESERVED = 12
#: a document more than so many times the median of its block is drawn first
LARGE = 8
#: in a source of several blocks, a document of more than this share of a block's words is drawn before the blocks are made
WHOLE_SOURCE = 1 / 16
MOST = 3.0
_EPS = 1e-9


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n = [len(t.split()) if t else 0 for t in b.column(2).cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], names=["doc_id", "source", "size"])


def flight(pi: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Move probabilities along null vectors of (1, size) until at most two are left between 0 and 1."""
    pi, size = pi.astype(float).tolist(), size.astype(float).tolist()
    draws = iter(rng.random(len(pi) + 8).tolist())
    todo = [i for i, p in enumerate(pi) if _EPS < p < 1 - _EPS]
    todo.reverse()
    hand: list[int] = []
    while True:
        while len(hand) < 3 and todo:
            hand.append(todo.pop())
        if len(hand) < 3:
            break
        a, b, c = hand
        u = (size[b] - size[c], size[c] - size[a], size[a] - size[b])
        if u == (0.0, 0.0, 0.0):
            u = (1.0, -1.0, 0.0)
        up = down = float("inf")
        for i, x in zip(hand, u, strict=True):
            if x > 0:
                up, down = min(up, (1 - pi[i]) / x), min(down, pi[i] / x)
            elif x < 0:
                up, down = min(up, pi[i] / -x), min(down, (1 - pi[i]) / -x)
        step = up if next(draws) * (up + down) < down else -down
        for i, x in zip(hand, u, strict=True):
            p = pi[i] + step * x
            pi[i] = 0.0 if p < _EPS else 1.0 if p > 1 - _EPS else p
        hand = [i for i in hand if 0.0 < pi[i] < 1.0]
    return np.array(pi)


def _open(pi: np.ndarray) -> np.ndarray:
    return (pi > _EPS) & (pi < 1 - _EPS)


def settle_large(pi: np.ndarray, whole: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> None:
    """Draw the documents much larger than most, the largest first, while all smaller ones keep the number of words. Sizes fall.

    A draw that the smaller ones can make up for by their probabilities is preferred to one that takes whole copies of them (none below 0, none
    above MOST in all), and that to one that misses; between equals the probability decides.
    """
    at = np.flatnonzero(_open(pi) & (size > 0))
    if len(at) < 2:
        return
    p, s = pi[at], size[at]
    large = LARGE * float(np.median(s))
    for k in range(len(at) - 1):
        if s[k] <= large:
            break
        rest = at[k + 1 :]
        every = float(s[k + 1 :].sum())
        want = float(p[k:] @ s[k:])
        low, high = -float(whole[rest].min()) * every, (MOST - float(whole[rest].max())) * every
        off = [(max(low - left, left - high, 0.0), max(-left, left - every, 0.0)) for left in (want, want - s[k])]
        take = rng.random() < p[k] if off[0] == off[1] else off[1] < off[0]
        left = min(max(want - take * s[k], low), high)
        lift = int(np.floor(left / every)) if not 0 <= left <= every else 0
        lift = min(lift, int(MOST) - 1 - int(whole[rest].max()))
        whole[rest] += lift
        left -= lift * every
        now = float(p[k + 1 :] @ s[k + 1 :])
        p[k] = float(take)
        if left <= now:
            p[k + 1 :] *= left / now if now > 0 else 0.0
        else:
            p[k + 1 :] = 1 - (1 - p[k + 1 :]) * max(0.0, (every - left) / (every - now))
    pi[at] = p


def kept_back(pi: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places of RESERVED open documents at most, the first about as large as the largest, each next one about half as large."""
    free = np.flatnonzero(_open(pi) & (size > 0)).tolist()
    held: list[int] = []
    want = float(size[free[0]]) if free else 0.0
    while free and len(held) < RESERVED:
        held.append(free.pop(int(np.abs(size[free] - want).argmin())))
        want = max(1.0, want / 2)
    return np.array(held, int)


def landing(pi: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Round the last probabilities (RESERVED + 2 at most) so that the words drawn stay nearest to what was asked, then the documents."""
    open_ = np.flatnonzero(_open(pi))
    out = np.round(pi)
    if not len(open_):
        return out
    want, rows = float(pi[open_] @ size[open_]), float(pi[open_].sum())
    choices = (np.arange(1 << len(open_))[:, None] >> np.arange(len(open_))) & 1
    off = np.abs(choices @ size[open_] - want) / max(1.0, float(size[open_].mean())) + 0.05 * np.abs(choices.sum(axis=1) - rows)
    out[open_] = choices[int(np.argmin(off))]
    return out


def _fly(seed: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(minus=-pdf["size"]).sort_values(["minus", "order", "doc_id"], kind="stable", ignore_index=True)
        size = pdf["size"].to_numpy(float)
        pi, whole = pdf["pi"].to_numpy(float, copy=True), pdf["whole"].to_numpy(np.int64, copy=True)
        rng = np.random.default_rng([seed, int(pdf["order"].min()) & 0x7FFFFFFF, len(pdf)])
        settle_large(pi, whole, size, rng)
        held = kept_back(pi, size)
        aside = pi[held].copy()
        pi[held] = 0.0
        pi = flight(pi, size, rng)
        pi[held] = aside
        if pdf["parts"].iat[0] == 1:
            pi = landing(pi, size)
        return pdf.assign(pi=pi, whole=whole.astype("int32"))[["doc_id", "source", "size", "whole", "order", "pi"]]

    return run


def targets(sized: DataFrame, most: float = MOST, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """source, source_size, n, target: shares by weight, stopped at ``most`` times the source's size, the excess reshared."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1  # one row for each source
    per = written(per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))), "sources")
    total, weight = per.agg(F.sum("source_size"), F.sum("weight")).first()
    theta, stopped = (total or 0) / (weight or 1.0), -1
    while True:
        over = F.lit(theta) * F.col("weight") > F.lit(most) * F.col("source_size")
        cap, rest, n = per.agg(F.sum(F.when(over, F.col("source_size") * most)), F.sum(F.when(~over, F.col("weight"))), F.sum(over.cast("long"))).first()
        if not n or n == stopped or not rest:
            break
        stopped, theta = n, (total - cap) / rest
    target = F.least(F.lit(theta) * F.col("weight"), F.lit(most) * F.col("source_size"))
    return per.select("source", "source_size", "n", target.cast("double").alias("target"))


def _copies():
    return F.col("whole") + F.round("pi").cast("int")


def _state(rows: DataFrame) -> DataFrame:
    """Rows with a ratio as whole copies and probabilities."""
    whole = F.floor(F.col("ratio") + 1e-9)
    return rows.select("doc_id", "source", "size", whole.cast("int").alias("whole"), "order", F.greatest(F.lit(0.0), F.col("ratio") - whole).alias("pi"), "parts")


def _drawn(state: DataFrame, seed: int, block: int) -> DataFrame:
    """Flights in blocks of each source, then of what is left of them, until every probability is 0 or 1."""
    shape = "doc_id long, source string, size long, whole int, order long, pi double"
    done, turn = None, 0
    while True:
        cut = F.pmod(F.xxhash64("order", F.lit(turn)), F.col("parts"))
        flown = written(state.withColumn("cut", cut).groupBy("source", "cut").applyInPandas(_fly(seed + turn), shape), "flight")
        settled = (F.col("pi") <= _EPS) | (F.col("pi") >= 1 - _EPS)
        done = flown.where(settled) if done is None else done.union(flown.where(settled))
        left = flown.where(~settled)
        if left.head(1) == []:
            return done
        count = left.groupBy(F.col("source").alias("of")).agg(F.ceil(F.count(F.lit(1)) / block).cast("long").alias("parts"))
        state = left.join(count, left["source"].eqNullSafe(count["of"])).select("doc_id", "source", "size", "whole", "order", "pi", "parts")
        turn += 1


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 11, block: int = BLOCK) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, copies, taken (size times copies).

    Null texts have size 0; a null source is a source of its own, the last one; a source without words has target 0
    and gives nothing. Ties and repeated rows are drawn one by one, in the order of a hash of doc_id; where more rows than a quarter
    of a block share one identifier, or have none, their places in the table deal them over the blocks. Very long texts are
    counted whole. An empty table gives no rows. Columns other than the three named are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text"))
    sized = written(src.mapInArrow(_counted, "doc_id long, source string, size long").withColumn("row", F.monotonically_increasing_id()), "sizes")
    goal = targets(sized)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    crowded = sized.groupBy(F.col("doc_id").alias("of")).agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > block // 4)
    if crowded.head(1):
        # equal identifiers have equal hashes, and would all fall into one block
        hot = written(crowded, "crowded")
        sized = sized.join(hot, sized["doc_id"].eqNullSafe(hot["of"]), "left").withColumn("salt", F.when(F.col("k").isNotNull(), F.col("row")))
    else:
        sized = sized.withColumn("salt", F.lit(None).cast("long"))
    same = sized["source"].eqNullSafe(goal["source"])
    rows = sized.join(goal, same).select("doc_id", sized["source"], "size", "salt", "source_size", "target", ratio.alias("ratio"), F.ceil(F.col("n") / block).cast("long").alias("parts"))
    rows = rows.withColumn("order", hash63(F.col("doc_id"), F.col("salt"), F.lit(seed)))
    vast = (F.col("parts") > 1) & (F.col("size") * F.col("parts") > F.col("source_size") * WHOLE_SOURCE)
    if rows.where(vast).head(1):
        own = rows.where(vast).withColumn("parts", F.lit(1).cast("long")) if rows.where(vast).count() <= block else rows.where(vast)
        first = written(_drawn(_state(own), seed, block), "vast")
        # what is left of each source's target, for what is left of its words
        gone = first.groupBy(F.col("source").alias("of")).agg(F.sum("size").alias("had"), F.sum(F.col("size") * _copies()).alias("got"))
        met = rows.where(~vast).join(F.broadcast(gone), rows["source"].eqNullSafe(gone["of"]), "left")  # a row a source
        words, want = F.col("source_size") - F.coalesce("had", F.lit(0)), F.greatest(F.lit(0.0), F.col("target") - F.coalesce("got", F.lit(0)))
        rest = met.withColumn("ratio", F.when(words > 0, F.least(F.lit(MOST), want / words)).otherwise(F.lit(0.0)))
        drawn = first.union(_drawn(_state(rest), seed, block))
    else:
        drawn = _drawn(_state(rows), seed, block)
    out = drawn.join(goal, drawn["source"].eqNullSafe(goal["source"])).select("doc_id", drawn["source"], "size", "source_size", "target", _copies().alias("copies"))
    return out.withColumn("taken", F.col("size") * F.col("copies"))
