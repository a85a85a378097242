"""Numbers from 0 over all rows of a table, found bucket by bucket: no task sorts the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(rows: DataFrame, name: str, bucket: Column, *order: Column | str, within: list[str] | None = None) -> DataFrame:
    """Adds ``name``: each row's place in the order of ``order``, from 0, among all rows or ``within`` groups.

    ``bucket`` is not null and never falls as the order rises, such as a prefix of the first key: rows are numbered within their bucket
    and moved up by the sizes of the buckets before it. What is summed in one task is one row a bucket.
    """
    within = within or []
    b = rows.withColumn("__b", bucket)
    sizes = b.groupBy(*within, "__b").agg(F.count(F.lit(1)).alias("__n"))
    starts = sizes.select(*[F.col(c).alias(f"__w{i}") for i, c in enumerate(within)], F.col("__b").alias("__c"), (F.sum("__n").over(Window.partitionBy(*within).orderBy("__b")) - F.col("__n")).alias("__s"))
    place = F.row_number().over(Window.partitionBy(*within, "__b").orderBy(*order)) - 1
    same = F.col("__b") == F.col("__c")
    for i, c in enumerate(within):
        same &= F.col(c).eqNullSafe(F.col(f"__w{i}"))
    return b.withColumn(name, place).join(starts, same).withColumn(name, (F.col(name) + F.col("__s")).cast("long")).select(*rows.columns, *([name] if name not in rows.columns else []))


def hash_prefix(score: Column) -> Column:
    """Bucket of a hexadecimal digest: 4,096 even ones."""
    return F.substring(score, 1, 3)


def number_range(value: Column, size: int = 1 << 16) -> Column:
    """Bucket of a number: ranges of ``size``."""
    return F.floor(value / size)


def smallest(rows: DataFrame, score: str, count: Column, *order: Column | str, within: list[str]) -> DataFrame:
    """The rows of each group ``within`` that come first by a hexadecimal digest and ``order``: ``count`` of them (a column that is one for the group).

    A histogram of the digests' beginnings says where each group is cut; rows before the cut stay by a filter, and only those at the cut, one in 4,096,
    are put in order. ``rows`` is read twice, so it should be cheap to make or written. One row a group is broadcast: groups are a bounded list.
    """
    r = rows.withColumn("__p", hash_prefix(F.col(score)))
    per = r.withColumn("__c", count).groupBy(*within, "__p").agg(F.count(F.lit(1)).alias("__n"), F.max("__c").alias("__c"))
    upto = F.sum("__n").over(Window.partitionBy(*within).orderBy("__p"))  # 4,096 rows a group
    cuts = per.withColumn("__s", upto - F.col("__n")).where(F.col("__s") < F.col("__c")).groupBy(*within).agg(F.max(F.struct("__p", "__s", "__c")).alias("__m"))
    cuts = cuts.select(*[F.col(c).alias(f"__w{i}") for i, c in enumerate(within)], F.col("__m.__p").alias("__cut"), (F.col("__m.__c") - F.col("__m.__s")).alias("__left"))
    same = F.lit(True)
    for i, c in enumerate(within):
        same &= F.col(c).eqNullSafe(F.col(f"__w{i}"))
    met = r.join(F.broadcast(cuts), same).where(F.col("__p") <= F.col("__cut"))
    place = F.row_number().over(Window.partitionBy(*within, "__p").orderBy(score, *order))
    edge = met.where(F.col("__p") == F.col("__cut")).withColumn("__r", place).where(F.col("__r") <= F.col("__left"))
    return met.where(F.col("__p") < F.col("__cut")).select(*rows.columns).unionByName(edge.select(*rows.columns))


#: rows of one bucket that are put in order together
CROWD = 1 << 16


def numbered_in_time(rows: DataFrame, name: str, at: str, key: str, crowd: int = CROWD) -> DataFrame:
    """Adds ``name``: each row's place from 0 in the order of ``at`` (a time as text, or null) and ``key`` (a hexadecimal digest).

    Buckets are hours; an hour of more than ``crowd`` rows is cut by seconds, such a second by its exact times, such a time by beginnings of the key as long as
    its rows ask for. So no task puts more than about that many rows in order, be all of one time or none.
    """
    time = F.coalesce(F.col(at), F.lit(""))
    finer = [F.substring(time, 1, 13), F.substring(time, 1, 19), time]
    b = rows.withColumn("__t0", finer[0])
    cut = F.struct("__t0")
    names = ["__t0"]
    for level in range(3):
        full = b.groupBy(*names).agg(F.count(F.lit(1)).alias("__k")).where(F.col("__k") > crowd)
        if not full.head(1):
            break
        full = full.select(*[F.col(n).alias(f"__f{n}") for n in names], "__k")
        same = F.lit(True)
        for n in names:
            same &= F.col(n).eqNullSafe(F.col(f"__f{n}"))
        digits = F.ceil(F.log(16.0, F.col("__k") / crowd)).cast("int")
        next_ = finer[level + 1] if level < 2 else F.substring(F.col(key), F.lit(1), digits)
        b = b.join(full, same, "left").withColumn(f"__t{level + 1}", F.when(F.col("__k").isNotNull(), next_)).drop("__k", *[f"__f{n}" for n in names])
        names.append(f"__t{level + 1}")
        cut = F.struct(*[F.coalesce(F.col(n), F.lit("")).alias(n) for n in names])
    return numbered(b.withColumn("__time", time), name, cut, "__time", key).select(*rows.columns, name)
