"""Helpers that the corpus operators share: tables, batches, gapless ranks; written tables in the shared folder come from the session's module."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexispark.session import shared_dir, spread, temporary, written

__all__ = ["hash63", "load", "shared_dir", "small_batches", "temporary", "width", "with_rank", "written"]

BATCH_ROWS = 1024
BATCH_BYTES = 16 << 20


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table; one so small that a single task may read all of it is dealt over the cores by its first column, the identifier."""
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return spread(df, df.columns[0])


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches sent to Python workers: texts may be very long, so ten thousand rows are too many."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def with_rank(df: DataFrame, out: str, spread: Column, order: list[Column], within: list[str] | None = None, per_bucket: int = 20_000, total: int | None = None) -> DataFrame:
    """Add ``out``: a gapless rank from 0 (within the columns ``within``), in the order of ``spread`` then ``order``.

    ``spread`` is a non-negative 64-bit value, evenly distributed (a hash). It is cut into buckets of about
    ``per_bucket`` rows; only the buckets' counts meet in one task, the rows are numbered bucket by bucket.
    """
    within = within or []
    rows = df.count() if total is None else total
    n = max(1, -(-rows // per_bucket))
    df = df.withColumn("__bucket", F.floor(spread.cast("double") / F.lit(float(2**63)) * n).cast("long")).withColumn("__spread", spread)
    sizes = df.groupBy(*within, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*within).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*within, "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    place = Window.partitionBy(*within, "__bucket").orderBy("__spread", *order)
    numbered = df.withColumn("__place", F.row_number().over(place).cast("long") - 1)
    on = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [*within, "__bucket"]]
    both = on[0]
    for c in on[1:]:
        both = both & c
    kept = [F.col(f"l.{c}") for c in df.columns if c not in ("__bucket", "__spread")]
    return numbered.alias("l").join(starts.alias("r"), both).select(*kept, (F.col("l.__place") + F.col("r.__start")).alias(out))


def hash63(*cols: Column) -> Column:
    return F.xxhash64(*cols).bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF))
