"""Structure of an incidence: density, lengths, frequencies, ambiguity, access and co-occurrence similarity.

Inputs: ``docs`` (doc_id, lang), ``keywords`` (lang, rank, token, df; K rows a language, K bounded by configuration) and
``inc`` (lang, doc_id, rank). All grids over keyword pairs are K x K and come after the top-K cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexispark.operators.numbering import number_range
from lexispark.session import written


def r6(c):
    return F.round(c, 6)


def lengths(docs: DataFrame, inc: DataFrame) -> DataFrame:
    """Keywords of every document, also of those without any: lang, doc_id, n."""
    per = inc.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    return docs.select("lang", "doc_id").join(per, "doc_id", "left").select("lang", "doc_id", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def profile(docs: DataFrame, keywords: DataFrame, inc: DataFrame) -> DataFrame:
    """One row a language: size, density, document lengths, and the distribution of keyword frequencies."""
    size = lengths(docs, inc).groupBy("lang").agg(
        F.count(F.lit(1)).alias("docs"), F.sum("n").alias("incidences"), F.sum((F.col("n") == 0).cast("long")).alias("empty_docs"),
        F.avg("n").alias("len_mean"), F.stddev_samp("n").alias("len_sd"), F.percentile("n", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"),
    )
    by = Window.partitionBy("lang")
    ranked = keywords.withColumn("up", F.row_number().over(by.orderBy("df", F.desc("token")))).withColumn("k", F.count(F.lit(1)).over(by)).withColumn("all", F.sum("df").over(by)).withColumn("same", F.count(F.lit(1)).over(Window.partitionBy("lang", "df")))
    p = F.col("df") / F.col("all")
    freq = ranked.groupBy("lang").agg(
        F.count(F.lit(1)).alias("keywords"), F.avg("df").alias("df_mean"), F.stddev_samp("df").alias("df_sd"), (F.stddev_pop("df") / F.avg("df")).alias("df_cv"),
        (2 * F.sum(F.col("up") * F.col("df")) / (F.max("k") * F.max("all")) - (F.max("k") + 1) / F.max("k")).alias("gini"),
        F.when(F.max("k") > 1, F.sum(-p * F.ln(p)) / F.ln(F.max("k").cast("double"))).otherwise(F.lit(0.0)).alias("entropy"),
        (F.sum(F.when(F.col("rank") < F.greatest(F.lit(1), F.ceil(F.col("k") * 0.01)), F.col("df")).otherwise(0)) / F.max("all")).alias("top1_share"),
        (F.sum(F.when(F.col("rank") < F.greatest(F.lit(1), F.ceil(F.col("k") * 0.1)), F.col("df")).otherwise(0)) / F.max("all")).alias("top10_share"),
        F.avg((F.col("same") > 1).cast("double")).alias("alternative_share"), F.max("same").alias("largest_group"), F.percentile("df", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("fq"),
        F.countDistinct(F.when(F.col("same") > 1, F.col("df"))).alias("frequency_groups"),
    )
    return size.join(freq, "lang").select(
        "lang", "docs", "keywords", "incidences", "empty_docs", r6(F.col("incidences") / (F.col("docs") * F.col("keywords"))).alias("density"), r6("len_mean").alias("len_mean"), r6("len_sd").alias("len_sd"),
        *[r6(F.col("q")[i]).alias(f"len_{q}") for i, q in enumerate(("q25", "q50", "q75"))], *[r6(F.col("fq")[i]).alias(f"df_{q}") for i, q in enumerate(("q25", "q50", "q75"))], *[r6(c).alias(c) for c in ("df_mean", "df_sd", "df_cv", "gini", "entropy", "top1_share", "top10_share", "alternative_share")], "largest_group", "frequency_groups",
    )


def frequency_ambiguity(keywords: DataFrame, tolerances: list[int]) -> DataFrame:
    """Pairs of keywords whose frequencies differ by a tolerance at most, and the keywords in such pairs.

    Keywords are counted by frequency; a range frame of the tolerance sums those counts around each frequency, so nothing is joined in pairs.
    """
    df = keywords.groupBy("lang", "df").agg(F.count(F.lit(1)).alias("c"))
    k = keywords.groupBy("lang").agg(F.count(F.lit(1)).alias("k"))
    out = None
    for t in tolerances:
        near = F.sum("c").over(Window.partitionBy("lang").orderBy("df").rangeBetween(-t, t))  # distinct frequencies of a language's top keywords
        hit = df.withColumn("others", near - 1).groupBy("lang").agg(F.sum(F.when(F.col("others") > 0, F.col("c"))).alias("touched"), (F.sum(F.col("c") * F.col("others")) / 2).cast("long").alias("pairs"))
        one = k.join(hit, "lang", "left").select("lang", F.lit(t).cast("long").alias("tolerance"), F.coalesce("pairs", F.lit(0)).cast("long").alias("pairs"), r6(F.coalesce("pairs", F.lit(0)) / (F.col("k") * (F.col("k") - 1) / 2)).alias("pair_share"), F.coalesce("touched", F.lit(0)).cast("long").alias("touched"), r6(F.coalesce("touched", F.lit(0)) / F.col("k")).alias("touched_share"))
        out = one if out is None else out.unionByName(one)
    return out


def cooccurrence(inc: DataFrame) -> DataFrame:
    """lang, i, j, n for i < j that share a document. A document holds at most K keywords, so the self join is bounded by K a row."""
    sets = inc.groupBy("lang", "doc_id").agg(F.sort_array(F.collect_list("rank")).alias("r"))
    pairs = sets.select("lang", F.posexplode("r").alias("p", "i"), "r").select("lang", "i", F.explode(F.slice("r", F.col("p") + 2, F.size("r"))).alias("j"))
    return pairs.groupBy("lang", "i", "j").agg(F.count(F.lit(1)).alias("n"))


def access_jaccard(keywords: DataFrame, cooc: DataFrame) -> DataFrame:
    """Jaccard similarity of the document sets of all keyword pairs, also of those that never meet: lang, i, j, jaccard."""
    a, b = keywords.select("lang", F.col("rank").alias("i"), F.col("df").alias("x")), keywords.select("lang", F.col("rank").alias("j"), F.col("df").alias("y"))
    grid = a.join(b, "lang").where("i < j").join(cooc, ["lang", "i", "j"], "left")
    n = F.coalesce("n", F.lit(0))
    under = F.col("x") + F.col("y") - n
    return grid.select("lang", "i", "j", F.when(under != 0, n / under).otherwise(F.lit(0.0)).alias("jaccard"))


def jaccard_summary(jac: DataFrame, threshold: float = 0.2) -> DataFrame:
    both = jac.select("lang", F.explode(F.array("i", "j")).alias("i"), "jaccard")
    near = both.groupBy("lang", "i").agg(F.max("jaccard").alias("m"), F.max((F.col("jaccard") == 1).cast("long")).alias("twin")).groupBy("lang").agg(F.percentile("m", F.lit(0.5)).alias("nearest_median"), F.max("m").alias("nearest_max"), F.sum("twin").alias("identical_keywords"))
    own = jac.groupBy("lang").agg(F.count(F.lit(1)).alias("pairs"), F.percentile("jaccard", F.array(F.lit(0.5), F.lit(0.9), F.lit(0.99))).alias("q"), F.avg((F.col("jaccard") > 0).cast("double")).alias("positive_share"), F.avg((F.col("jaccard") >= threshold).cast("double")).alias("similar_share"), F.sum((F.col("jaccard") == 1).cast("long")).alias("identical_pairs"))
    return own.join(near, "lang").select("lang", "pairs", *[r6(F.col("q")[i]).alias(n) for i, n in enumerate(("q50", "q90", "q99"))], r6("positive_share").alias("positive_share"), r6("similar_share").alias("similar_share"), "identical_pairs", "identical_keywords", r6("nearest_median").alias("nearest_median"), r6("nearest_max").alias("nearest_max"))


def cooccurrence_cosine(keywords: DataFrame, cooc: DataFrame) -> DataFrame:
    """Cosine of the co-occurrence profiles (own entry zero) of all keyword pairs, 0 if a profile is empty: lang, i, j, cosine."""
    full = cooc.select("lang", "i", "j", "n").union(cooc.select("lang", F.col("j").alias("i"), F.col("i").alias("j"), "n"))
    norm = full.groupBy("lang", "i").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    a, b = full.select("lang", F.col("j").alias("m"), "i", F.col("n").alias("x")), full.select("lang", F.col("j").alias("m"), F.col("i").alias("j"), F.col("n").alias("y"))
    dot = a.join(b, ["lang", "m"]).where("i < j").groupBy("lang", "i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    left = keywords.select("lang", F.col("rank").alias("i")).join(norm, ["lang", "i"], "left").withColumnRenamed("norm", "ni")
    right = left.select("lang", F.col("i").alias("j"), F.col("ni").alias("nj"))
    return left.join(right, "lang").where("i < j").join(dot, ["lang", "i", "j"], "left").select("lang", "i", "j", F.coalesce(F.col("dot") / (F.col("ni") * F.col("nj")), F.lit(0.0)).alias("cosine"))


def partition_rmse(n_a: DataFrame, df_a: DataFrame, n_b: DataFrame, df_b: DataFrame, cooc_a: DataFrame, cooc_b: DataFrame, keywords: DataFrame) -> DataFrame:
    """Distance of two partitions: root mean square of keyword probabilities and of pair probabilities. n_*: (lang, n)."""
    sizes = n_a.withColumnRenamed("n", "na").join(n_b.withColumnRenamed("n", "nb"), "lang")
    kw = keywords.select("lang", "rank")
    m = kw.join(df_a.withColumnRenamed("df", "a"), ["lang", "rank"], "left").join(df_b.withColumnRenamed("df", "b"), ["lang", "rank"], "left").join(sizes, "lang")
    z = lambda c: F.coalesce(c, F.lit(0))
    marginal = m.groupBy("lang").agg(F.sqrt(F.avg(F.pow(z("a") / F.col("na") - z("b") / F.col("nb"), 2))).alias("marginal_rmse"))
    grid = kw.withColumnRenamed("rank", "i").join(kw.withColumnRenamed("rank", "j"), "lang").where("i < j").join(cooc_a.withColumnRenamed("n", "a"), ["lang", "i", "j"], "left").join(cooc_b.withColumnRenamed("n", "b"), ["lang", "i", "j"], "left").join(sizes, "lang")
    pair = grid.groupBy("lang").agg(F.sqrt(F.avg(F.pow(z("a") / F.col("na") - z("b") / F.col("nb"), 2))).alias("cooccurrence_rmse"))
    return marginal.join(pair, "lang").select("lang", r6("marginal_rmse").alias("marginal_rmse"), r6("cooccurrence_rmse").alias("cooccurrence_rmse"))


FEATURES = ("matrix_density", "mean_document_length", "frequency_cv", "exact_alternative_share", "five_alternative_share", "median_nearest_jaccard", "similar_pair_share", "median_cosine")


def features(docs: DataFrame, keywords: DataFrame, inc: DataFrame) -> DataFrame:
    """One row a language with the scalars by which sweeps and conditions are compared (``FEATURES``), and selected and incidence counts.

    Shares of alternatives: keywords with another one of equal frequency, or within five documents of theirs. Similar pairs: Jaccard 0.5 or more.
    """
    cooc = written(cooccurrence(inc), "pairs")
    jac = written(access_jaccard(keywords, cooc), "jaccard")
    size = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"))
    count = inc.groupBy("lang").agg(F.count(F.lit(1)).alias("incidence_count"))
    kw = keywords.groupBy("lang").agg(F.count(F.lit(1)).alias("selected_count"), (F.stddev_pop("df") / F.avg("df")).alias("frequency_cv"))
    near = frequency_ambiguity(keywords, [0, 5]).groupBy("lang").agg(F.max(F.when(F.col("tolerance") == 0, F.col("touched"))).alias("t0"), F.max(F.when(F.col("tolerance") == 5, F.col("touched"))).alias("t5"))
    both = jac.select("lang", F.explode(F.array("i", "j")).alias("i"), "jaccard").groupBy("lang", "i").agg(F.max("jaccard").alias("m")).groupBy("lang").agg(F.percentile("m", F.lit(0.5)).alias("median_nearest_jaccard"))
    pair = jac.groupBy("lang").agg(F.avg((F.col("jaccard") >= 0.5).cast("double")).alias("similar_pair_share"))
    cos = cooccurrence_cosine(keywords, cooc).groupBy("lang").agg(F.percentile("cosine", F.lit(0.5)).alias("median_cosine"))
    out = size.join(kw, "lang", "left").join(count, "lang", "left")
    for other in (near, both, pair, cos):
        out = out.join(other, "lang", "left")
    n = F.coalesce("incidence_count", F.lit(0))
    made = {"matrix_density": n / (F.col("docs") * F.col("selected_count")), "mean_document_length": n / F.col("docs"), "exact_alternative_share": F.col("t0") / F.col("selected_count"), "five_alternative_share": F.col("t5") / F.col("selected_count")}
    return out.select("lang", "selected_count", n.alias("incidence_count"), *[made.get(f, F.col(f)).alias(f) for f in FEATURES])


def group_differences(metrics: DataFrame, by: list[str], group: str, left: str, right: str, names: list[str]) -> DataFrame:
    """One group's metrics less another's under the same condition (``by``); null where either is."""
    side = lambda g, p: metrics.where(F.col(group) == g).select(*by, *[F.col(n).alias(f"{p}{n}") for n in names])
    return side(left, "l_").join(side(right, "r_"), by, "full_outer").select(*by, *[(F.col(f"l_{n}") - F.col(f"r_{n}")).alias(n) for n in names])


def incidence_digest(inc: DataFrame) -> DataFrame:
    """A digest of each language's incidence, whatever the order of its rows: of its documents' lists in ranges, then of the ranges. lang, incidences, sha256."""
    lists = inc.groupBy("lang", "doc_id").agg(F.array_join(F.sort_array(F.collect_list("rank")), ",").alias("k"), F.count(F.lit(1)).alias("n"))  # K a document
    line = F.struct("doc_id", F.concat_ws(":", F.col("doc_id").cast("string"), "k").alias("t"))
    joined = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(c)), lambda s: s["t"]), "\n")
    parts = lists.withColumn("b", number_range(F.col("doc_id"))).groupBy("lang", "b").agg(F.sha2(joined(line), 256).alias("h"), F.sum("n").alias("n"))  # a bounded range
    return parts.groupBy("lang").agg(F.sum("n").alias("incidences"), F.sha2(joined(F.struct("b", F.col("h").alias("t"))), 256).alias("sha256"))


def metric_differences(metrics: DataFrame, by: list[str], condition: str, baseline: str, names: list[str]) -> DataFrame:
    """Each condition's metrics less the baseline's of the same group; null where either is."""
    base = metrics.where(F.col(condition) == baseline).select(*by, *[F.col(n).alias(f"__{n}") for n in names])
    rest = metrics.where(F.col(condition) != baseline).join(base, by, "left")
    return rest.select(*by, condition, *[(F.col(n) - F.col(f"__{n}")).alias(n) for n in names])
