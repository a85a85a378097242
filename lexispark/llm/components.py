"""Connected components of a link table, wholly in Spark: no link, node or label is ever collected to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.llm.common import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over links (a, b): every node hands its neighbours the smallest node it knows.

    Large stars link the larger neighbours to that smallest node, small stars the smaller ones and the node itself;
    both keep the components as they are. The smallest neighbour is a pre-aggregated minimum, joined back, so a node with very many
    links is split by the skew join and is never gathered.
    """
    if large:
        near = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = near.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).withColumn("m", F.least("u", "m"))
    met = near.join(low, near["a"] == low["u"])
    if large:
        out = met.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): for each node with a link to another, the smallest node it can reach, itself included.

    Alternates large and small stars until nothing changes; every round is written to the shared folder, so lineage
    stays short. Repeated links, links both ways and loops do no harm; nulls take no part; no links: no rows.
    """
    edges = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    edges = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    seen = mark(edges)
    while seen[0]:
        edges = written(_star(_star(edges, True), False), "links")
        now = mark(edges)
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots.select("node", F.col("node").alias("component")))
