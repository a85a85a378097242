"""Controlled changes of an incidence: collisions, similarity, equal frequencies, thinning. Draws rank by hash.

An incidence has the columns of ``by`` (such as the language), doc and kw; keywords of different groups have nothing to do with each
other. Pairs (by, donor, recipient) are a bounded list. Documents are ranked bucket by bucket of their hashes, so that no
task holds all documents of a keyword or a pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispark.functions.text import stable_score
from lexispark.operators.numbering import hash_prefix, numbered, smallest


def _ranked(rows: DataFrame, score: Column, within: list[str]) -> DataFrame:
    """Adds r: the place, from 1, by hash and document."""
    scored = rows.withColumn("__score", score)
    return numbered(scored, "r", hash_prefix(F.col("__score")), "__score", "doc", within=within).withColumn("r", F.col("r") + 1).drop("__score")


def _without(inc: DataFrame, kws: DataFrame, by: list[str]) -> DataFrame:
    return inc.join(kws, [*by, "kw"], "left_anti").select(*by, "doc", "kw")


def _sized(inc: DataFrame, pairs: DataFrame, by: list[str]) -> DataFrame:
    """Pairs with the frequencies a and b of donor and recipient."""
    df = inc.groupBy(*by, "kw").agg(F.count(F.lit(1)).alias("df"))
    side = lambda end, name: df.withColumnRenamed("kw", end).withColumnRenamed("df", name)
    return pairs.join(side("donor", "a"), [*by, "donor"]).join(side("recipient", "b"), [*by, "recipient"])


def _grid(docs: DataFrame, pairs: DataFrame, by: list[str]) -> DataFrame:
    """Each pair with each document of its group: pairs are a bounded list, so this is one pass over the documents for each of them."""
    return docs.select(*by, "doc").join(F.broadcast(pairs), by) if by else docs.select("doc").crossJoin(F.broadcast(pairs))


def checked(value: Column, ok: Column, why: str) -> Column:
    """The value, or an error where it is not ``ok``."""
    return F.when(ok, value).otherwise(F.raise_error(F.lit(why)).cast("long"))


def collide(inc: DataFrame, pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The recipient's column becomes the donor's. ``pairs``: donor, recipient."""
    by = by or []
    copied = inc.join(F.broadcast(pairs.withColumnRenamed("donor", "kw")), [*by, "kw"]).select(*by, "doc", F.col("recipient").alias("kw"))
    return _without(inc, pairs.select(*by, F.col("recipient").alias("kw")), by).unionByName(copied)


def thin(inc: DataFrame, rate: float | Column, minimum: int, seed: int, by: list[str] | None = None) -> DataFrame:
    """Keep min(df, max(minimum, round(rate df))) documents of each keyword, the first of a fixed order: smaller rates nest in larger ones."""
    by = by or []
    df = inc.groupBy(*by, "kw").agg(F.count(F.lit(1)).alias("n"))
    rate = F.lit(rate) if isinstance(rate, float) else rate
    keep = df.select(*by, "kw", F.least(F.col("n"), F.greatest(F.lit(minimum), F.bround(F.col("n") * rate, 0))).alias("keep"))
    r = _ranked(inc.select(*by, "doc", "kw"), stable_score(seed, F.col("kw"), F.col("doc")), [*by, "kw"])
    return r.join(keep, [*by, "kw"]).where("r <= keep").select(*by, "doc", "kw")


def order_inversions(before: DataFrame, after: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Keyword pairs whose order by frequency was strictly turned round: empty if the weak order holds. Inputs: by, kw, df; K x K a group."""
    by = by or []
    m = before.withColumnRenamed("df", "x").join(after.withColumnRenamed("df", "y"), [*by, "kw"])
    side = lambda end: m.select(*by, F.col("kw").alias(end), F.col("x").alias(f"x{end}"), F.col("y").alias(f"y{end}"))
    both = side("i").join(side("j"), by) if by else side("i").crossJoin(side("j"))
    return both.where("xi > xj and yi < yj").select(*by, "i", "j")


def similar_access(inc: DataFrame, docs: DataFrame, pairs: DataFrame, target: float, seed: int, by: list[str] | None = None) -> DataFrame:
    """Redraw each recipient so that its Jaccard similarity with the donor is the target; its frequency stays.

    overlap = min(round(J (a + b) / (1 + J)), a, b) documents come from the donor's, the others from outside; too few outside are an error.
    """
    by = by or []
    n = docs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    p = _sized(inc, pairs, by)
    p = p.join(n, by) if by else p.crossJoin(n)  # n is one row a group
    k = F.least(F.bround(F.lit(target) * (F.col("a") + F.col("b")) / (1 + target), 0), F.col("a"), F.col("b")).cast("long")
    p = p.withColumn("k", k).withColumn("k", checked(F.col("k"), F.col("n") - F.col("a") >= F.col("b") - F.col("k"), "too few documents without the donor"))
    own = inc.select(*by, "doc", F.col("kw").alias("donor"), F.lit(True).alias("in"))
    g = _grid(docs, p, by).join(own, [*by, "doc", "donor"], "left").withColumn("in", F.coalesce("in", F.lit(False)))
    scored = g.withColumn("__score", stable_score(f"{seed}:similar", F.col("donor"), F.col("recipient"), F.col("doc")))
    drawn = smallest(scored, "__score", F.when(F.col("in"), F.col("k")).otherwise(F.col("b") - F.col("k")), "doc", within=[*by, "donor", "recipient", "in"]).select(*by, "doc", F.col("recipient").alias("kw"))
    return _without(inc, pairs.select(*by, F.col("recipient").alias("kw")), by).unionByName(drawn)


def equalise(inc: DataFrame, docs: DataFrame, pairs: DataFrame, seed: int, by: list[str] | None = None) -> DataFrame:
    """Both keywords of a pair get their integer mean frequency, on disjoint documents; an error if these are more than there are."""
    by = by or []
    n = docs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    p = _sized(inc, pairs, by).withColumn("f", F.floor((F.col("a") + F.col("b")) / 2))
    p = p.join(n, by) if by else p.crossJoin(n)  # n is one row a group
    p = p.withColumn("f", checked(F.col("f"), 2 * F.col("f") <= F.col("n"), "too few documents for two disjoint sets"))
    score, pair = stable_score(f"{seed}:equal", F.col("donor"), F.col("recipient"), F.col("doc")), [*by, "donor", "recipient"]
    r = _ranked(smallest(_grid(docs, p, by).withColumn("__score", score), "__score", 2 * F.col("f"), "doc", within=pair), score, pair)
    drawn = r.select(*by, "doc", F.when(F.col("r") <= F.col("f"), F.col("donor")).otherwise(F.col("recipient")).alias("kw"))
    return _without(inc, pairs.select(*by, F.explode(F.array("donor", "recipient")).alias("kw")), by).unionByName(drawn)


def invariants(before: DataFrame, after: DataFrame, pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """What an intervention kept or made, for each pair: by, donor, recipient, identical, preserved_df, equal_df, disjoint."""
    key = [*(by or []), "donor", "recipient"]
    ends = F.explode(F.array(F.struct(F.col("donor").alias("kw"), F.lit(1).alias("d")), F.struct(F.col("recipient").alias("kw"), F.lit(0).alias("d")))).alias("e")
    side = pairs.select(*key, ends).select(*key, "e.kw", "e.d")
    per = lambda x: x.join(F.broadcast(side), [*(by or []), "kw"]).groupBy(*key, "doc").agg(F.max("d").alias("d"), F.max(1 - F.col("d")).alias("r")).groupBy(*key)
    new = per(after).agg(F.sum("d").alias("x"), F.sum("r").alias("y"), F.sum(F.col("d") * F.col("r")).alias("n"))
    old = per(before).agg(F.sum("r").alias("old"))
    c = F.col
    flags = [((c("n") == c("x")) & (c("n") == c("y"))).alias("identical"), (c("y") == c("old")).alias("preserved_df"), (c("x") == c("y")).alias("equal_df"), (c("n") == 0).alias("disjoint")]
    return new.join(old, key).select(*key, *flags)
