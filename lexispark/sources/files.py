"""Readers and writers: JSON lines, aligned text, headed tables, snapshots, incidence artefacts."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexispark.operators.numbering import numbered

RAW = (
    "source_id string, language string, canonical_url string, fetched_url string, published_at string, retrieved_at string, title string, body string, "
    "authors array<string>, section string, tags array<string>, http_status int, content_type string, raw_reference string, parser_version string"
)


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType = RAW) -> DataFrame:
    """One JSON object a line; blank lines are skipped, a line that is not JSON fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_jsonl(df: DataFrame, path: str, *order: str) -> None:
    """Objects with sorted keys, nulls kept, one a line. Equal tables give equal bytes: the rows lie in one order over all parts (of ``order``, then of the line itself)."""
    lines = df.select(*[F.col(c).alias(f"__o{i}") for i, c in enumerate(order)], F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("value"))
    lines.orderBy(*[f"__o{i}" for i in range(len(order))], "value").select("value").write.mode("overwrite").text(path)


def read_manifest(spark: SparkSession, path: str, key: str = "source_id", schema: str | T.StructType | None = None) -> DataFrame:
    """The entries of a JSON file {"sources": [...]}, one row each; an entry without its key, or two of one key, are an error."""
    reader = spark.read.option("multiLine", True).option("mode", "FAILFAST")
    if schema is not None:
        reader = reader.schema(T.StructType([T.StructField("sources", T.ArrayType(T.StructType.fromDDL(schema) if isinstance(schema, str) else schema))]))
    rows = reader.json(path).select(F.explode("sources").alias("s")).select("s.*")
    if again := rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col(key).isNull() | (F.col("n") > 1)).head(1):
        raise ValueError(f"{key} is missing or repeats: {again[0][0]}")
    return rows


# line ends beyond those that the file reader knows (fixed values)
_ENDS = "[\\x0B\\x0C\\x1C-\\x1E\\x{85}\\x{2028}\\x{2029}]"


def _numbered(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Lines with their number from 0, in file order. A file is read in splits; lines are numbered within their split and moved up by the splits before it."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    first = F.when((F.col("block") == 0) & (F.col("at") == F.min("at").over(Window.partitionBy("file", "block"))), F.regexp_replace("value", "^\\x{FEFF}", "")).otherwise(F.col("value"))
    parts = lines.withColumn("value", first).select("file", "block", "at", F.posexplode(F.split("value", _ENDS, -1)).alias("part", name))
    return numbered(parts, "row", F.struct("file", "block"), "file", "block", "at", "part").select("row", name)


def read_aligned(spark: SparkSession, left: str, right: str) -> DataFrame:
    """row, left, right of two texts aligned line by line; unequal lengths are an error."""
    a, b = _numbered(spark, left, "left"), _numbered(spark, right, "right")
    both = a.join(b, "row", "full_outer")
    odd = F.col("left").isNull() | F.col("right").isNull()
    return both.withColumn("left", F.when(odd, F.raise_error(F.lit("the two files differ in length")).cast("string")).otherwise(F.col("left")))


def read_table(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Tab-separated rows under exactly these columns."""
    df = spark.read.option("sep", "\t").option("header", True).csv(path)
    if set(df.columns) != set(columns):
        raise ValueError(f"columns {sorted(df.columns)}, not {sorted(columns)}")
    return df.select(*columns)


def read_snapshots(spark: SparkSession, path: str, pinned: str | None = None, crc32: int | None = None, size: int | None = None) -> DataFrame:
    """path, content, size, sha256, crc32 of binary files; a file that differs from the pinned digest, checksum or size fails."""
    df = spark.read.format("binaryFile").load(path).select("path", "content", F.octet_length("content").cast("long").alias("size"), F.sha2("content", 256).alias("sha256"), F.crc32("content").alias("crc32"))
    for name, want in (("sha256", pinned), ("crc32", crc32), ("size", size)):
        if want is not None:
            wrong = F.raise_error(F.concat(F.lit(f"{name} differs from the pinned one: "), "path")).cast(df.schema[name].dataType)
            df = df.withColumn(name, F.when(F.col(name) == want, F.col(name)).otherwise(wrong))
    return df


def table_digest(df: DataFrame) -> tuple[int, str]:
    """Rows of a table and a digest that does not hang on their order: of the sums of two independent hashes of each row."""
    cols = [F.col(c) for c in sorted(df.columns)]
    n, a, b = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*cols).cast("decimal(38,0)")), F.sum(F.xxhash64(F.lit(1), *cols).cast("decimal(38,0)"))).first()
    return n, hashlib.sha256(f"{n}:{a}:{b}".encode()).hexdigest()


def write_artifacts(path: str, **frames: DataFrame) -> DataFrame:
    """Each frame under its own name, committed by the writer's protocol; then their metadata (name, rows, columns, sha256), which is returned.

    The metadata come last, so a folder that has them is whole.
    """
    spark = next(iter(frames.values())).sparkSession
    made = []
    for name, df in frames.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        back = spark.read.parquet(f"{path}/{name}")
        made.append((name, *table_digest(back), ",".join(sorted(back.columns))))
    meta = spark.createDataFrame([(n, k, c, h) for n, k, h, c in made], "name string, rows long, columns string, sha256 string")  # one row a frame
    meta.coalesce(1).write.mode("overwrite").json(f"{path}/metadata")
    return meta


def verify_artifacts(spark: SparkSession, path: str) -> list[str]:
    """Names of the frames in a folder that are not what its metadata say; empty if it is whole."""
    meta = spark.read.schema("name string, rows long, columns string, sha256 string").json(f"{path}/metadata").collect()  # one row a frame
    return [r.name for r in meta if table_digest(spark.read.parquet(f"{path}/{r.name}")) != (r.rows, r.sha256)]


def write_export(docs: DataFrame, path: str) -> None:
    """Keyword lists partitioned by language, condition and k."""
    docs.write.mode("overwrite").partitionBy("lang", "condition", "k").parquet(path)
