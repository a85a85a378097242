"""Exact deduplication by a tree-merge of sorted digest runs.

Every input partition forms one *run*: its digests, each with the best identifier seen and a count. Runs are then
exchanged in binomial rounds: a round sends the runs whose numbers agree but for their lowest ``fan_bits`` bits to the
same place (per range of the digest space, so that no task ever holds more than a share of it), sorts them together
and merges them in one streaming pass that keeps one entry for each digest. After the last round one sorted run per
range is left. The decisions go back down the tree: first to the (run, digest) pairs of the first level, of which a
group of copies has one per run at most, then to the documents of that run; a group that holds a third of all rows
is therefore never gathered in one task.

Entries are *verified*: equal entries must agree in SHA-256, in the length in bytes and in an independent 64-bit
hash of the same bytes; entries that differ in any of them stay apart.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.llm.common import small_batches, width, written

FAN_BITS = 3
_DIGESTS = "doc_id long, digest binary, n_bytes long, check long, run int"
_ENTRY = ["space", "run", "digest", "n_bytes", "check", "best", "n"]


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256, length and xxh3 of each text, with A-Z lower-cased (bytes.lower touches ASCII only); null is empty."""
    for b in batches:
        texts = [(t or b"").lower() for t in b.column(1).cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                b.column(0),
                pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array(np.array([xxhash.xxh3_64_intdigest(t) for t in texts], np.uint64).view(np.int64)),
                b.column(2),
            ],
            names=["doc_id", "digest", "n_bytes", "check", "run"],
        )


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One streaming merge of sorted runs: adjacent equal entries become one, with the largest ``best`` and the sum of ``n``.

    Memory: one batch and one carried entry, whatever the size of the runs.
    """
    carry: pa.Table | None = None
    schema = None
    for b in batches:
        schema = b.schema
        t = pa.Table.from_batches([b])
        if carry is not None:
            t = pa.concat_tables([carry, t])
        t = t.combine_chunks()
        if not t.num_rows:
            continue
        new = np.ones(t.num_rows, bool)
        if t.num_rows > 1:
            same = np.ones(t.num_rows - 1, bool)
            for c in ("space", "run", "digest", "n_bytes", "check"):
                x = t.column(c).chunk(0)
                same &= pc.equal(x.slice(1), x.slice(0, t.num_rows - 1)).to_numpy(zero_copy_only=False)
            new[1:] = ~same
        at = np.flatnonzero(new)
        best = np.maximum.reduceat(t.column("best").to_numpy(), at)
        n = np.add.reduceat(t.column("n").to_numpy(), at)
        first = t.take(pa.array(at))
        out = pa.Table.from_arrays([*first.columns[:5], pa.chunked_array([best], pa.int64()), pa.chunked_array([n], pa.int64())], schema=schema)
        carry = out.slice(out.num_rows - 1)
        if out.num_rows > 1:
            yield from out.slice(0, out.num_rows - 1).combine_chunks().to_batches()
    if carry is not None and carry.num_rows:
        yield from carry.combine_chunks().to_batches()
    elif schema is None:
        return


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", fan_bits: int = FAN_BITS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    ``keep``: "max" or "min", the identifier that stays of each group of texts equal but for the case of A-Z.
    Null and empty texts are equal. Rows repeated with the same identifier belong to the group as often as they
    occur; all of them carry ``kept`` true if their identifier is the one that stays. A null identifier never
    stays unless the whole group has none (then keep_id is null and kept is false). Empty table: no rows.
    Columns other than the two named are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    sign = 1 if keep == "max" else -1
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.spark_partition_id().alias("run"))
    rows = written(src.mapInArrow(_digested, _DIGESTS), "digests")
    top = rows.agg(F.max("run")).first()[0]
    lowest = -(2**63) + 1
    spaces = width(spark)
    entries = rows.groupBy("run", "digest", "n_bytes", "check").agg(F.max(F.coalesce(F.col("doc_id") * sign, F.lit(lowest))).alias("best"), F.count(F.lit(1)).alias("n"))
    # ranges of the digest space: its first 31 bits, cut evenly
    lead = F.conv(F.substring(F.hex("digest"), 1, 8), 16, 10).cast("long")
    level = entries.select(F.floor(lead * spaces / F.lit(2.0**32)).cast("int").alias("space"), "run", "digest", "n_bytes", "check", "best", "n")
    runs = (top or 0) + 1
    first = level
    while True:
        level = level.withColumn("run", F.shiftright("run", fan_bits))
        runs = -(-runs // (1 << fan_bits))
        level = level.select(*_ENTRY).repartition(spaces, "space", "run").sortWithinPartitions("space", "run", "digest", "n_bytes", "check").mapInArrow(_merged, level.select(*_ENTRY).schema)
        if runs <= 1:
            break
    done = level.select("digest", "n_bytes", "check", F.when(F.col("best") > lowest, F.col("best") * sign).alias("keep_id"), F.col("n").alias("group_size"))
    down = first.select("run", "digest", "n_bytes", "check").join(done, ["digest", "n_bytes", "check"])
    out = rows.join(down, ["run", "digest", "n_bytes", "check"])
    return out.select("doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
