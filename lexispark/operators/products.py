"""Products of sparse keyword matrices for thousands of keywords a language, in square blocks of keywords.

A block is one row: lang, bi, bj (numbers of keyword blocks, bi <= bj), at (cells, row-major) and n (their counts). Documents are multiplied where they
lie: a task adds up the blocks of its own documents and sends each block once, not a row for every pair of keywords of every document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: keywords on a block's side
SIDE = 256
#: pairs of keywords that are made at a time; one document of more is taken alone
PAIRS = 1 << 22
#: bytes of blocks that a task adds up before it sends them
HELD = 128 << 20
#: cells of a product of zeros and ones that cost about as much as one pair of keywords
DENSE = 400
#: first sums of a block; each takes the parts of its share of the tasks, so that no task takes those of all
FAN = 64

BLOCK = "lang string, bi int, bj int, part int, at array<int>, n array<long>"


def _runs(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Neighbouring documents whose pairs are ``most`` together at most; a document of more stands alone."""
    begin, held = 0, 0
    for at, size in enumerate(sizes):
        if held and held + size > most:
            yield slice(begin, at)
            begin, held = at, 0
        held += size
    if begin < len(sizes):
        yield slice(begin, len(sizes))


def document_pairs(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All i < j of each sorted list, list after list."""
    size = np.array([len(x) for x in lists], dtype=np.int64)
    flat = np.concatenate(lists) if len(lists) else np.empty(0, dtype=np.int64)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    after = np.repeat(size, size) - 1 - place
    step = np.arange(after.sum()) - np.repeat(np.cumsum(after) - after, after)
    return np.repeat(flat, after), flat[np.repeat(np.arange(len(flat)), after) + 1 + step]


def _cells(i: np.ndarray, j: np.ndarray, side: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """bi, bj and the cells in that block of pairs i < j."""
    if not len(i):
        return
    bi, bj = i // side, j // side
    wide = int(bj.max()) + 1
    block = (bi * wide + bj).astype(np.min_scalar_type(wide * wide))  # narrow numbers are sorted by their digits, in linear time
    order = np.argsort(block, kind="stable")
    cell = ((i - bi * side) * side + (j - bj * side))[order]
    own, edge = np.unique(block[order], return_index=True)
    for k, a, b in zip(own.tolist(), edge, np.r_[edge[1:], len(cell)]):
        yield k // wide, k % wide, cell[a:b]


def _rows(held: dict[tuple, np.ndarray], part: int) -> pd.DataFrame:
    """Blocks as rows of their cells that are not zero."""
    made = [(*key, part, at := np.flatnonzero(block), block[at].astype(np.int64)) for key, block in held.items()]
    return pd.DataFrame([(lang, bi, bj, p, at.astype(np.int32), n) for lang, bi, bj, p, at, n in made], columns=["lang", "bi", "bj", "part", "at", "n"])


def _summed(blocks: DataFrame, by: list[str], side: int) -> DataFrame:
    """Blocks of equal ``by`` added up: sorted within their partition and met one after another, so a task holds one sum and one batch."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, total = None, None
        for batch in batches:
            for row in batch.itertuples(index=False):
                now = (row.lang, row.bi, row.bj, row.part)
                if now != key:
                    if key is not None:
                        yield _rows({key[:3]: total}, key[3])
                    key, total = now, np.zeros(side * side, dtype=np.int64)
                total[row.at] += row.n
        if key is not None:
            yield _rows({key[:3]: total}, key[3])

    return blocks.repartition(*by).sortWithinPartitions(*by).mapInPandas(add, BLOCK)


def cooccurrence_blocks(inc: DataFrame, side: int = SIDE) -> DataFrame:
    """Documents that hold both of two keywords, as blocks of the upper triangle: lang, bi, bj, at, n. ``inc``: lang, doc_id, rank (from 0).

    Repeated rows count once; a null language is a language; rows without doc_id or rank take no part. An empty incidence has no blocks.
    """
    sets = inc.where("doc_id is not null and rank is not null").groupBy("lang", "doc_id").agg(F.sort_array(F.collect_set(F.col("rank").cast("long"))).alias("r"))  # K a document
    return blocks_of_lists(sets, side)


def _dense(lists: list[np.ndarray], side: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """bi, bj and the counts of that block, by products of the documents' rows of zeros and ones; whole numbers below 2^24 are exact in single precision."""
    size = np.array([len(x) for x in lists], dtype=np.int64)
    flat = np.concatenate(lists)
    blocks = int(flat.max()) // side + 1
    held = np.zeros((len(lists), blocks * side), dtype=np.float32)
    held[np.repeat(np.arange(len(lists)), size), flat] = 1
    for bi in range(blocks):
        left = held[:, bi * side : (bi + 1) * side].T
        for bj in range(bi, blocks):
            n = left @ held[:, bj * side : (bj + 1) * side]
            if bi == bj:
                n = np.triu(n, 1)
            if n.any():
                yield bi, bj, n.ravel().astype(np.int64)


def blocks_of_lists(sets: DataFrame, side: int = SIDE) -> DataFrame:
    """``cooccurrence_blocks`` of documents with their sorted distinct keywords: lang, r (array<long>), a row a document.

    Documents that hold many of the keywords are multiplied as rows of zeros and ones, which costs the square of the keywords each; others pair by pair.
    """
    # a batch of documents is small next to the blocks, however many keywords each of them holds
    lists = sets.where(F.size("r") > 1).select("lang", "r", (F.spark_partition_id() % FAN).alias("part"))

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, part = {}, 0
        for batch in batches:
            part = int(batch["part"].iloc[0]) if len(batch) else part
            for lang, own in batch.groupby("lang", dropna=False, sort=False)["r"]:
                lang = None if pd.isna(lang) else lang
                own = own.tolist()
                size = np.array([len(x) for x in own], dtype=np.int64)
                for run in _runs(size * (size - 1) // 2, PAIRS):
                    docs, most = own[run], max(int(x[-1]) for x in own[run]) + 1
                    if (size[run] * (size[run] - 1) // 2).sum() * DENSE > len(docs) * most * most:
                        made = _dense(docs, side)
                    else:
                        made = ((bi, bj, np.bincount(cells, minlength=side * side)) for bi, bj, cells in _cells(*document_pairs(docs), side))
                    for bi, bj, n in made:
                        block = held.setdefault((lang, bi, bj), np.zeros(side * side, dtype=np.int64))
                        block += n
                    if len(held) * side * side * 8 > HELD:
                        yield _rows(held, part)
                        held = {}
        if held:
            yield _rows(held, part)

    parts = _summed(lists.mapInPandas(multiply, BLOCK), ["lang", "bi", "bj", "part"], side)
    return _summed(parts.withColumn("part", F.lit(0)), ["lang", "bi", "bj", "part"], side).drop("part")


def pairs_of_blocks(blocks: DataFrame, side: int = SIDE) -> DataFrame:
    """lang, i, j, n: a row for each cell of the blocks."""
    cells = blocks.select("lang", "bi", "bj", F.explode(F.arrays_zip("at", "n")).alias("c"))
    at = F.col("c.at")
    return cells.select("lang", (F.col("bi") * side + F.floor(at / side)).cast("long").alias("i"), (F.col("bj") * side + at % side).cast("long").alias("j"), F.col("c.n").alias("n"))


def profile_products(blocks: DataFrame, side: int = SIDE) -> DataFrame:
    """Inner products of the rows of the whole symmetric matrix, whose upper triangle ``blocks`` holds: lang, i, j (i <= j), dot (double); zeros lack.

    Each pair of blocks that share their middle block is multiplied as two dense matrices; for one block of the result they come one after another, so a task
    holds three blocks. Blocks are sent as often as there are blocks on a side: K^2 * K / side cells, packed, in place of K^3 joined rows.
    Products are sums of doubles: exact below 2^53. ``blocks`` is read twice and should be written.
    """
    turned = F.transform("at", lambda a: ((a % side) * side + F.floor(a / side)).cast("int"))
    # a block off the diagonal stands for both triangles; one on it holds i < j only, so its mirror image is added to it
    full = blocks.select("lang", "bi", "bj", "at", "n").unionByName(blocks.select("lang", F.col("bj").alias("bi"), F.col("bi").alias("bj"), turned.alias("at"), "n"))
    left = full.select(F.col("lang").alias("ll"), F.col("bj").alias("m"), "bi", F.col("at").alias("la"), F.col("n").alias("ln"))
    right = full.select("lang", F.col("bj").alias("rm"), F.col("bi").alias("bj"), F.col("at").alias("ra"), F.col("n").alias("rn"))
    met = left.join(right, F.col("ll").eqNullSafe(F.col("lang")) & (F.col("m") == F.col("rm"))).where("bi <= bj").select("lang", "bi", "bj", "la", "ln", "ra", "rn")

    def dense(at: np.ndarray, n: np.ndarray) -> np.ndarray:
        out = np.zeros(side * side)
        out[at] = n
        return out.reshape(side, side)

    def cells(key: tuple, total: np.ndarray) -> pd.DataFrame:
        lang, bi, bj = key
        i, j = np.nonzero(total)
        dot = total[i, j]
        i, j = i + bi * side, j + bj * side
        keep = i <= j
        return pd.DataFrame({"lang": pd.Series([lang] * int(keep.sum()), dtype=object), "i": i[keep], "j": j[keep], "dot": dot[keep]})

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, total = None, None
        for batch in batches:
            for row in batch.itertuples(index=False):
                now = (row.lang, row.bi, row.bj)
                if now != key:
                    if key is not None:
                        yield cells(key, total)
                    key, total = now, np.zeros((side, side))
                total += dense(row.la, row.ln) @ dense(row.ra, row.rn).T
        if key is not None:
            yield cells(key, total)

    return met.repartition("lang", "bi", "bj").sortWithinPartitions("lang", "bi", "bj").mapInPandas(multiply, "lang string, i long, j long, dot double")


def profile_cosine(products: DataFrame) -> DataFrame:
    """lang, i, j, cosine of the pairs i < j whose co-occurrence profiles meet; it is 0 for all others. ``products`` is read twice and should be written."""
    norm = products.where("i = j").select(F.col("lang").alias("nl"), F.col("i").alias("k"), F.sqrt("dot").alias("norm"))  # K rows a language
    n = lambda end, name: norm.select(F.col("nl").alias(f"{end}l"), F.col("k").alias(f"{end}k"), F.col("norm").alias(name))
    met = products.where("i < j").join(F.broadcast(n("x", "ni")), F.col("lang").eqNullSafe(F.col("xl")) & (F.col("i") == F.col("xk")))
    met = met.join(F.broadcast(n("y", "nj")), F.col("lang").eqNullSafe(F.col("yl")) & (F.col("j") == F.col("yk")))
    return met.select("lang", "i", "j", (F.col("dot") / (F.col("ni") * F.col("nj"))).alias("cosine"))
