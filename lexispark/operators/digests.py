"""Tables kept with a tree of digests, sixteen children a node, over ranges of their keys: two of them are compared by reading only the ranges that differ.

A range is a beginning of the key's SHA-256, so ranges are even and a changed row stays in its range. A leaf's digest is made of the number of its rows and two
sums of independent parts of each row's SHA-256: it hangs on no order, and is summed before anything is shuffled. An inner node's digest is that of its children's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexispark.session import written

#: the folder of rows is cut into directories by this column
RANGE = "__range"
#: directories of a table are listed by the driver when it is read, so a tree is four digits deep at most
DEEPEST = 4


def row_text(columns: list[str]) -> Column:
    """A row's columns in the order of their names, nulls kept: equal texts mean equal rows. Binary columns are in base 64, times in UTC as the session writes them."""
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(columns)]), {"ignoreNullFields": "false"})


def key_range(key: list[str], depth: int) -> Column:
    return F.substring(F.sha2(row_text(key), 256), 1, depth)


def digest_tree(rows: DataFrame, key: list[str], depth: int) -> DataFrame:
    """level (0: the root), node (a beginning of the key's digest), n (rows), digest; nodes without rows lack, so an empty table has no rows here.

    At most 16 ** depth leaves; what is aggregated is one row a leaf and task.
    """
    if not 1 <= depth <= DEEPEST:
        raise ValueError(f"depth {depth} is not from 1 to {DEEPEST}")
    hashed = rows.select(key_range(key, depth).alias("node"), F.sha2(row_text(rows.columns), 256).alias("h"))
    return _upwards(written(_leaves(hashed), "leaves"), depth)


def _leaves(hashed: DataFrame) -> DataFrame:
    part = lambda at: F.sum(F.conv(F.substring("h", at, 15), 16, 10).cast("decimal(38,0)"))
    sums = hashed.groupBy("node").agg(F.count(F.lit(1)).alias("n"), part(1).alias("a"), part(16).alias("b"))
    return sums.select("node", "n", F.sha2(F.concat_ws(":", F.col("n").cast("string"), F.col("a").cast("string"), F.col("b").cast("string")), 256).alias("digest"))


def _upwards(leaves: DataFrame, depth: int) -> DataFrame:
    level = leaves.select(F.lit(depth).alias("level"), "node", "n", "digest")
    out = level
    for up in range(depth - 1, -1, -1):
        child = F.struct("node", F.concat_ws(":", "node", "digest").alias("t"))  # sixteen at most
        text = F.array_join(F.transform(F.sort_array(F.collect_list(child)), lambda c: c["t"]), ",")
        level = level.groupBy(F.substring("node", 1, up).alias("node")).agg(F.sum("n").alias("n"), F.sha2(text, 256).alias("digest")).select(F.lit(up).alias("level"), "node", "n", "digest")
        out = out.unionByName(level)
    return out


def write_with_tree(rows: DataFrame, path: str, key: list[str], depth: int = 2) -> DataFrame:
    """Write ``rows`` in a directory for each range, then the tree of what was written, which is returned. A folder with its tree is whole.

    A range that holds far more than others, as when one key is a third of all rows, is split between tasks. Columns may not be called ``__range``.
    """
    if RANGE in rows.columns:
        raise ValueError(f"{RANGE} is the name of the ranges")
    spark = rows.sparkSession
    cut = rows.withColumn(RANGE, F.concat(F.lit("r"), key_range(key, depth)))  # a letter first, lest directories be read as numbers
    cut.hint("rebalance", RANGE).write.mode("errorifexists").partitionBy(RANGE).parquet(f"{path}/rows")
    digest_tree(_rows(spark, path, rows.schema), key, depth).write.parquet(f"{path}/tree")
    return read_tree(spark, path)


def read_tree(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("level int, node string, n long, digest string").parquet(f"{path}/tree")


def _rows(spark: SparkSession, path: str, schema: T.StructType, nodes: list[str] | None = None) -> DataFrame:
    """The rows of all ranges, or of the leaves ``nodes``: then no other directory is even listed."""
    reader = spark.read.schema(T.StructType([*schema.fields, T.StructField(RANGE, T.StringType())]))
    if nodes is None:
        return reader.parquet(f"{path}/rows").drop(RANGE)
    if not nodes:
        return spark.createDataFrame([], schema)
    return reader.option("basePath", f"{path}/rows").parquet(*[f"{path}/rows/{RANGE}=r{n}" for n in nodes]).drop(RANGE)


def changed_ranges(left: DataFrame, right: DataFrame) -> list[str]:
    """Leaves in which two trees differ, found from the root down: below a node that agrees nothing is looked at. 16 ** depth short strings at most."""
    both = left.withColumnRenamed("n", "ln").withColumnRenamed("digest", "ld").join(right.withColumnRenamed("n", "rn").withColumnRenamed("digest", "rd"), ["level", "node"], "full_outer")
    depth = max(t.agg(F.max("level")).first()[0] or 0 for t in (left, right))
    open_ = [""]
    for level in range(depth + 1):
        beneath = F.substring("node", 1, max(level - 1, 0)).isin(open_)
        open_ = [r.node for r in both.where((F.col("level") == level) & beneath & ~F.col("ld").eqNullSafe(F.col("rd"))).select("node").orderBy("node").collect()]
        if not open_:
            break
    return open_


def tree_differences(spark: SparkSession, left: str, right: str, schema: T.StructType) -> tuple[DataFrame, list[str]]:
    """Rows that only one of two written tables has, as often as it has them more (``side``: left or right), and the ranges that were read for them.

    Both were written by ``write_with_tree`` with the same schema, key and depth; other depths are an error. Equal tables read no rows at all.
    """
    trees = [read_tree(spark, p) for p in (left, right)]
    depths = {d for t in trees if (d := t.agg(F.max("level")).first()[0]) is not None}
    if len(depths) > 1:
        raise ValueError(f"trees of different depths: {sorted(depths)}")
    nodes = changed_ranges(*trees)
    held = [[r.node for r in t.where((F.length("node") > 0) & F.col("node").isin(nodes)).select("node").collect()] for t in trees]  # a range may be on one side only
    a, b = (_rows(spark, p, schema, n) for p, n in zip((left, right), held))
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right"))), nodes
