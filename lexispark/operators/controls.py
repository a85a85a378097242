"""Keyword controls: term lists, shuffles, keyword pairs for the interventions, length matching, co-occurrence matching."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexispark.functions.text import stable_score
from lexispark.operators.interventions import checked
from lexispark.operators.matching import disjoint_pairs, optimal_matching
from lexispark.operators.numbering import smallest
from lexispark.operators.places import transport
from lexispark.session import settled


def auxiliary_terms(df: DataFrame, n: int) -> DataFrame:
    """Terms (token, df) that some but not all auxiliary documents hold."""
    return df.where((F.col("df") > 0) & (F.col("df") < n))


def shared_terms(df: DataFrame, sources: DataFrame, k: int) -> DataFrame:
    """The k terms most frequent over all sources, of those that every source has: token, df. Fewer than k are an error.

    ``df``: source, token, df (a row a source and token); ``sources``: one row, n.
    """
    every = df.groupBy("token").agg(F.count(F.lit(1)).alias("in"), F.sum("df").alias("df")).crossJoin(F.broadcast(sources)).where("`in` = n")  # one row
    top = every.orderBy(F.desc("df"), "token").limit(k).select("token", "df")
    got = top.agg(F.count(F.lit(1)).alias("got"))
    return top.crossJoin(F.broadcast(got)).select("token", checked(F.col("df"), F.col("got") == k, "too few terms that every source has").alias("df"))


def restrict(inc: DataFrame, terms: DataFrame, by: list[str] | None = None) -> DataFrame:
    """An incidence (by, doc, kw) of the chosen terms only, renumbered: ``terms``: by, kw, rank."""
    by = by or []
    return inc.join(F.broadcast(terms.select(*by, "kw", "rank")), [*by, "kw"]).select(*by, "doc", F.col("rank").alias("kw"))


def shuffled(terms: DataFrame, seed: int, by: list[str] | None = None) -> DataFrame:
    """A seeded permutation of keyword numbers: by, kw, rank (from 0). K rows a group."""
    by = by or []
    place = F.row_number().over(Window.partitionBy(*by).orderBy(stable_score(seed, F.col("kw")), "kw"))
    return terms.select(*by, "kw", (place - 1).cast("long").alias("rank"))


def _grid(df: DataFrame, by: list[str], condition: str, score) -> DataFrame:
    """by, left, right, score of the keyword pairs that fit; K x K a group."""
    side = lambda end, p: df.select(*by, F.col("kw").alias(end), F.col("aux").alias(f"{p}a"), F.col("client").alias(f"{p}c"))
    a, b = side("left", "x"), side("right", "y")
    both = a.join(b, by) if by else a.crossJoin(b)
    return both.where("left < right").where(condition).select(*by, "left", "right", F.bround(score, 9).alias("score"))


_UNEQUAL = "xa > 0 and ya > 0 and xc > 0 and yc > 0 and xa <> ya and xc <> yc"


def similarity_pairs(df: DataFrame, count: int, target: float, by: list[str] | None = None) -> DataFrame:
    """Disjoint keyword pairs whose frequencies on both sides are unequal but near enough for the target similarity: by, left, right, score.

    ``df``: by, kw, aux, client. Score: the absolute log ratios of both sides, smallest first. Too few pairs are an error.
    """
    near = f"{_UNEQUAL} and least(xa, ya) / greatest(xa, ya) >= {target} and least(xc, yc) / greatest(xc, yc) >= {target}"
    return _first(_grid(df, by or [], near, F.abs(F.ln(F.col("xa") / F.col("ya"))) + F.abs(F.ln(F.col("xc") / F.col("yc")))), df, count, by or [])


def equalisation_pairs(df: DataFrame, count: int, by: list[str] | None = None) -> DataFrame:
    """Disjoint pairs with unequal frequencies of even sum on both sides, the smallest relative gaps first: by, left, right, score."""
    gap = lambda x, y: F.abs(F.col(x) - F.col(y)) / (F.col(x) + F.col(y))
    return _first(_grid(df, by or [], f"{_UNEQUAL} and (xa + ya) % 2 = 0 and (xc + yc) % 2 = 0", gap("xa", "ya") + gap("xc", "yc")), df, count, by or [])


def _first(edges: DataFrame, df: DataFrame, count: int, by: list[str]) -> DataFrame:
    """The first ``count`` disjoint pairs of each group; a group with fewer is an error."""
    got = disjoint_pairs(edges, [F.col("score"), F.col("left"), F.col("right")], by=by)
    top = got.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy("o0", "o1", "o2"))).where(F.col("__r") <= count)
    n = top.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    short = df.select(*by).distinct().join(n, by, "left").where(F.coalesce("n", F.lit(0)) < count) if by else n.where(F.col("n") < count)
    if short.head(1):
        raise ValueError(f"fewer than {count} disjoint pairs")
    return top.select(*by, "left", "right", F.col("o0").alias("score"))


#: most places of the smaller side that one task matches: what searches hold grows with them, not with their pairs
PLACES = 20_000


def length_matching(left: DataFrame, right: DataFrame, max_ratio: float, most: int = PLACES) -> DataFrame:
    """Optimal matching of pairs by length in both languages: the most pairs whose larger log ratio is within bounds, the least distance.

    Inputs: id, a, b (lengths in two languages). Lengths are whole numbers, so many rows share a place (a, b): places are matched with their numbers of rows, in runs of
    first lengths that no pair can leave, and rows are dealt to what goes from place to place by their ids. A run of more than ``most`` places is matched row by row.
    """
    bound = math.log(max_ratio) + 1e-12
    own = lambda rows, side: rows.where("a > 0 and b > 0").select(F.lit(side).alias("side"), "id", "a", "b")
    rows = settled(own(left, 0).unionByName(own(right, 1)))
    lengths = rows.select("a").distinct()
    gap = F.ln("a") - F.lag(F.ln("a")).over(Window.orderBy("a")) > bound
    runs = lengths.withColumn("g", gap.cast("long")).select("a", F.coalesce(F.sum("g").over(Window.orderBy("a")), F.lit(0)).alias("run"))  # one row a length
    places = settled(rows.groupBy("side", "a", "b").agg(F.count(F.lit(1)).alias("n")).join(runs, "a").withColumns({"la": F.ln("a"), "lb": F.ln("b")}))
    sizes = places.groupBy("run").agg(*[F.sum((F.col("side") == s).cast("long")).alias(f"n{s}") for s in (0, 1)])
    vast = settled(sizes.where(F.least("n0", "n1") > most).select("run"))
    kinds = {c: rows.schema[c].dataType.simpleString() for c in "ab"}
    schema = ", ".join(f"{end}_{c} {kinds[c]}" for end in ("left", "right") for c in "ab") + ", left_from long, right_from long, n long"
    ways = settled(places.join(vast, "run", "left_anti").groupBy("run").applyInPandas(lambda pdf: _place_pairs(pdf, bound), schema))
    unit = F.row_number().over(Window.partitionBy("side", "a", "b").orderBy("id")) - 1
    seats = rows.withColumn("unit", unit.cast("long"))
    dealt = ways.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    for s, end in enumerate(("left", "right")):
        seat = seats.where(F.col("side") == s).select(F.col("id").alias(end), F.col("a").alias(f"{end}_a"), F.col("b").alias(f"{end}_b"), F.col("unit").alias(f"{end}_unit"))
        dealt = dealt.withColumn(f"{end}_unit", F.col(f"{end}_from") + F.col("i")).join(seat, [f"{end}_a", f"{end}_b", f"{end}_unit"])
    apart = lambda c: F.abs(F.ln(f"left_{c}") - F.ln(f"right_{c}"))
    pairs = dealt.select("left", "right", (apart("a") + apart("b")).alias("cost"))
    if not vast.head(1):
        return pairs
    far = [rows.where(F.col("side") == s).join(runs, "a").join(vast, "run", "left_semi") for s in (0, 1)]
    return pairs.unionByName(_length_edges_matched(*far, bound))


def _place_pairs(pdf: pd.DataFrame, bound: float) -> pd.DataFrame:
    """Which places of a run are matched with which, and from which of their rows on."""
    sides = [pdf[pdf["side"] == s].sort_values(["la", "lb"], ignore_index=True) for s in (0, 1)]
    turned = sides[0]["n"].sum() > sides[1]["n"].sum()
    x, y = reversed(sides) if turned else sides
    (xa, xb), (ya, yb) = ([s[c].to_numpy(float) for c in ("la", "lb")] for s in (x, y))
    first, last = np.searchsorted(ya, xa - bound), np.searchsorted(ya, xa + bound, "right")

    def near(i: int) -> tuple[np.ndarray, np.ndarray]:
        run = slice(first[i], last[i])
        da, db = np.abs(ya[run] - xa[i]), np.abs(yb[run] - xb[i])
        k = np.flatnonzero((da <= bound) & (db <= bound))
        return k + first[i], (da + db)[k]

    at = {place: j for j, place in enumerate(zip(y["a"], y["b"], strict=True))}
    same = [(i, at[place]) for i, place in enumerate(zip(x["a"], x["b"], strict=True)) if place in at]
    given, got = [0] * len(x), [0] * len(y)
    out = []
    for i, j, units in transport(x["n"].tolist(), y["n"].tolist(), near, 2 * bound, same):
        ends = [(x["a"][i], x["b"][i], given[i]), (y["a"][j], y["b"][j], got[j])]
        (la, lb, lf), (ra, rb, rf) = reversed(ends) if turned else ends
        out.append((la, lb, ra, rb, lf, rf, units))
        given[i] += units
        got[j] += units
    return pd.DataFrame(out, columns=["left_a", "left_b", "right_a", "right_b", "left_from", "right_from", "n"])


def _length_edges_matched(left: DataFrame, right: DataFrame, bound: float) -> DataFrame:
    """All pairs within bounds, matched. The log length of the first is cut into buckets of the bound, so three buckets meet."""
    x = left.select(F.col("id").alias("left"), F.ln("a").alias("la"), F.ln("b").alias("lb"), F.explode(F.array(*[F.floor(F.ln("a") / bound) + i for i in (-1, 0, 1)])).alias("k"))
    y = right.select(F.col("id").alias("right"), F.ln("a").alias("ra"), F.ln("b").alias("rb"), F.floor(F.ln("a") / bound).alias("k"))
    da, db = F.abs(F.col("la") - F.col("ra")), F.abs(F.col("lb") - F.col("rb"))
    edges = x.join(y, "k").where((da <= bound) & (db <= bound)).select("left", "right", (da + db).alias("cost"), F.col("la").alias("at"))
    return optimal_matching(edges, at="at")


def cooccurrence_match(inc: DataFrame, docs: DataFrame, pairs: DataFrame, budget: int, seed: int, by: list[str] | None = None) -> DataFrame:
    """Redraw each recipient from documents without the donor, ``budget`` times, and keep the draw whose co-occurrence profile is nearest the donor's.

    Profiles leave out donor and recipient; nearness is the cosine (0 where a profile is empty), ties go to the first draw; the frequency
    stays. Returns by, donor, recipient, draw, cosine, df: ``drawn_incidence`` gives the documents of the draws that were kept.
    """
    by = by or []
    pair = [*by, "donor", "recipient"]
    kept = _draws(inc, docs, pairs, budget, seed, by)
    own = inc.select(*by, "doc", F.col("kw").alias("donor"))
    other = "kw <> donor and kw <> recipient"
    profile = kept.join(inc, [*by, "doc"]).where(other).groupBy(*pair, "draw", "kw").agg(F.count(F.lit(1)).alias("x"))
    target = F.broadcast(pairs).join(own, [*by, "donor"]).join(inc, [*by, "doc"]).where(other).groupBy(*pair, "kw").agg(F.count(F.lit(1)).alias("y"))
    norm = target.groupBy(*pair).agg(F.sqrt(F.sum(F.col("y") * F.col("y"))).alias("ny"))
    score = profile.join(target, [*pair, "kw"], "left").groupBy(*pair, "draw").agg(F.sum(F.col("x") * F.coalesce("y", F.lit(0))).alias("dot"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("nx"))
    every = pairs.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(budget - 1)))).join(score, [*pair, "draw"], "left").join(norm, pair, "left")
    cosine = F.bround(F.coalesce(F.try_divide(F.col("dot"), F.col("nx") * F.col("ny")), F.lit(0.0)), 9)
    best = every.withColumn("cosine", cosine).groupBy(*pair).agg(F.max_by(F.struct("draw", "cosine"), F.struct("cosine", -F.col("draw"))).alias("m")).select(*pair, "m.draw", "m.cosine")
    df = kept.groupBy(*pair, "draw").agg(F.count(F.lit(1)).alias("df"))
    return best.join(df, [*pair, "draw"]).select(*pair, "draw", "cosine", "df")


def _draws(inc: DataFrame, docs: DataFrame, pairs: DataFrame, budget: int, seed: int, by: list[str]) -> DataFrame:
    """by, donor, recipient, draw, doc: as many documents without the donor as the recipient has, for each draw, cut by a histogram of hashes."""
    size = inc.groupBy(*by, "kw").agg(F.count(F.lit(1)).alias("f")).withColumnRenamed("kw", "recipient")
    p = pairs.join(size, [*by, "recipient"])
    own = inc.select(*by, "doc", F.col("kw").alias("donor"))
    grid = (docs.select(*by, "doc").join(F.broadcast(p), by) if by else docs.select("doc").crossJoin(F.broadcast(p))).join(own, [*by, "doc", "donor"], "left_anti")  # pairs are a bounded list
    drawn = grid.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(budget - 1)))).withColumn("score", stable_score(f"{seed}:profile", F.col("donor"), F.col("recipient"), F.col("draw"), F.col("doc")))
    return smallest(drawn, "score", F.col("f"), "doc", within=[*by, "donor", "recipient", "draw"]).select(*by, "donor", "recipient", "draw", "doc")


def drawn_incidence(inc: DataFrame, docs: DataFrame, pairs: DataFrame, best: DataFrame, budget: int, seed: int, by: list[str] | None = None) -> DataFrame:
    """The incidence with each recipient's documents replaced by the draw that ``cooccurrence_match`` kept."""
    by = by or []
    new = _draws(inc, docs, pairs, budget, seed, by).join(best.select(*by, "donor", "recipient", "draw"), [*by, "donor", "recipient", "draw"]).select(*by, "doc", F.col("recipient").alias("kw"))
    return inc.join(pairs.select(*by, F.col("recipient").alias("kw")), [*by, "kw"], "left_anti").select(*by, "doc", "kw").unionByName(new)


def pair_sample(keywords: DataFrame, n: int, seed: int, by: list[str] | None = None) -> DataFrame:
    """n keyword pairs a group without replacement, by hash rank: by, i, j. The grid is K x K, of which only the first n are kept."""
    by = by or []
    a, b = keywords.select(*by, F.col("kw").alias("i")), keywords.select(*by, F.col("kw").alias("j"))
    grid = (a.join(b, by) if by else a.crossJoin(b)).where("i < j")
    place = F.row_number().over(Window.partitionBy(*by).orderBy(stable_score(seed, F.col("i"), F.col("j")), "i", "j"))
    return grid.withColumn("__r", place).where(F.col("__r") <= n).select(*by, "i", "j")
