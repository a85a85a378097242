"""Session-level helpers: the shared folder, cut lineages, tables spread over the cores."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: a table smaller than this for each core may stand in a single block of its file, which one task would read; about what a part has of a table that is dealt
SMALL_SHARE = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where that is unset, one of our own on a local master, an error on any other."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder, and the executors share none with the driver")
        place = "file://" + tempfile.mkdtemp(prefix="lexispark-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


def temporary(spark: SparkSession, path: str) -> None:
    """The files of this path, which exists, go when the application ends."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the lineage and survives lost executors.

    The result may be read until the application ends; then the files go.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lexispark/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    temporary(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def settled(df: DataFrame) -> DataFrame:
    """``written``, for the states of iterative operators."""
    return written(df, "state")


@contextlib.contextmanager
def sweeping(spark: SparkSession):
    """Within it a query's shuffle files go when it ends, not when the driver collects its garbage; for queries that end in a table written."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def swept(df: DataFrame) -> DataFrame:
    """``settled``, leaving no shuffle files."""
    with sweeping(df.sparkSession):
        return settled(df)


def spread(df: DataFrame, *by: Column | str) -> DataFrame:
    """A table dealt over all cores before heavy work on its rows, if it is small or lies unevenly; a large one in even parts stays as it is.

    A file is read in parts of some megabytes, but a block of its rows is one task's, however large. So rows are counted by task (no column is read for that): where one
    would have more than two cores' even share, the table is dealt in parts of some megabytes.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size < cores * SMALL_SHARE:
        return df.repartition(cores, *by)
    held = df.groupBy(F.spark_partition_id()).count().agg(F.sum("count").alias("n"), F.max("count").alias("most")).first()
    if held["most"] is None or held["most"] * cores <= 2 * held["n"]:
        return df
    # rows that come from no file are taken for endlessly large
    return df.repartition(max(cores, min(-(-size // SMALL_SHARE), held["n"] // 1024)), *by)
