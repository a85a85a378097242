"""Queries over the incidence of each language's top keywords."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.operators import incidence as inc
from lexispark.operators import products
from lexispark.operators import structure as sx
from lexispark.plans import oracle
from lexispark.registry import query, table
from lexispark.session import written

K = 60


def parts(spark: SparkSession, sf_dir: str, k: int = K) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents, keywords and incidence. Texts are tokenised once: their tokens are written, and so are the K keywords a language."""
    docs = table(spark, sf_dir, "documents")
    tok = inc.token_sets(docs)
    kw = written(inc.top_keywords(tok, k), "keywords")
    return docs.select("doc_id", "lang"), kw, inc.incidence(tok, kw)


@query(f"""WITH {oracle.keywords(K)}, l AS (SELECT d.lang, d.doc_id, count(rank) AS n FROM documents d LEFT JOIN inc USING (doc_id) GROUP BY ALL),
    s AS (SELECT lang, count(*) AS docs, CAST(sum(n) AS BIGINT) AS incidences, CAST(sum(CAST(n = 0 AS INT)) AS BIGINT) AS empty_docs, avg(n) AS len_mean, stddev_samp(n) AS len_sd, quantile_cont(n, 0.25) AS a, quantile_cont(n, 0.5) AS b, quantile_cont(n, 0.75) AS c FROM l GROUP BY lang),
    r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY df, token DESC) AS up, count(*) OVER (PARTITION BY lang) AS k, sum(df) OVER (PARTITION BY lang) AS total, count(*) OVER (PARTITION BY lang, df) AS same FROM kw),
    f AS (SELECT lang, count(*) AS keywords, quantile_cont(df, 0.25) AS fa, quantile_cont(df, 0.5) AS fb, quantile_cont(df, 0.75) AS fc, avg(df) AS df_mean, stddev_samp(df) AS df_sd, stddev_pop(df) / avg(df) AS df_cv, 2 * sum(up * df) / (max(k) * max(total)) - (max(k) + 1) / max(k) AS gini,
        CASE WHEN max(k) > 1 THEN sum(-df / total * ln(df / total)) / ln(max(k)) ELSE 0.0 END AS entropy, sum(CASE WHEN rank < greatest(1, ceil(k * 0.01)) THEN df ELSE 0 END) / max(total) AS top1_share, sum(CASE WHEN rank < greatest(1, ceil(k * 0.1)) THEN df ELSE 0 END) / max(total) AS top10_share,
        avg(CAST(same > 1 AS DOUBLE)) AS alternative_share, max(same) AS largest_group, count(DISTINCT CASE WHEN same > 1 THEN df END) AS frequency_groups FROM r GROUP BY lang)
    SELECT lang, docs, keywords, incidences, empty_docs, round(incidences / (docs * keywords), 6) AS density, round(len_mean, 6) AS len_mean, round(len_sd, 6) AS len_sd, round(a, 6) AS len_q25, round(b, 6) AS len_q50, round(c, 6) AS len_q75,
        round(fa, 6) AS df_q25, round(fb, 6) AS df_q50, round(fc, 6) AS df_q75, round(df_mean, 6) AS df_mean, round(df_sd, 6) AS df_sd, round(df_cv, 6) AS df_cv, round(gini, 6) AS gini, round(entropy, 6) AS entropy, round(top1_share, 6) AS top1_share, round(top10_share, 6) AS top10_share, round(alternative_share, 6) AS alternative_share, largest_group, frequency_groups FROM s JOIN f USING (lang)""")
def structure_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sx.profile(*parts(spark, sf_dir))


@query(f"""WITH {oracle.keywords(K)}, t AS (SELECT unnest([0, 1, 5]) AS tolerance), k AS (SELECT lang, count(*) AS k FROM kw GROUP BY lang),
    p AS (SELECT a.lang, tolerance, a.rank AS i, b.rank AS j FROM kw a JOIN kw b ON a.lang = b.lang AND a.rank < b.rank JOIN t ON abs(a.df - b.df) <= tolerance),
    u AS (SELECT lang, tolerance, count(DISTINCT x) AS touched FROM (SELECT lang, tolerance, i AS x FROM p UNION ALL SELECT lang, tolerance, j FROM p) GROUP BY ALL), c AS (SELECT lang, tolerance, count(*) AS pairs FROM p GROUP BY ALL)
    SELECT k.lang, CAST(t.tolerance AS BIGINT) AS tolerance, coalesce(pairs, 0) AS pairs, round(coalesce(pairs, 0) / (k * (k - 1) / 2), 6) AS pair_share, coalesce(touched, 0) AS touched, round(coalesce(touched, 0) / k, 6) AS touched_share
    FROM k CROSS JOIN t LEFT JOIN c ON c.lang = k.lang AND c.tolerance = t.tolerance LEFT JOIN u ON u.lang = k.lang AND u.tolerance = t.tolerance""")
def frequency_ambiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sx.frequency_ambiguity(parts(spark, sf_dir)[1], [0, 1, 5])


@query(f"WITH {oracle.cooc(K)} SELECT lang, i, j, n FROM cooc")
def cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sx.cooccurrence(parts(spark, sf_dir)[2])


@query(f"WITH {oracle.grid(K)} SELECT lang, i, j, round(jaccard, 6) AS jaccard FROM jac")
def access_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, kw, i = parts(spark, sf_dir)
    return sx.access_jaccard(kw, sx.cooccurrence(i)).withColumn("jaccard", F.round("jaccard", 6))


@query(f"""WITH {oracle.grid(K)}, b AS (SELECT lang, i, jaccard FROM jac UNION ALL SELECT lang, j, jaccard FROM jac), m AS (SELECT lang, i, max(jaccard) AS m, max(CAST(jaccard = 1 AS BIGINT)) AS twin FROM b GROUP BY ALL),
    n AS (SELECT lang, quantile_cont(m, 0.5) AS md, max(m) AS mx, CAST(sum(twin) AS BIGINT) AS identical_keywords FROM m GROUP BY lang)
    SELECT jac.lang, count(*) AS pairs, round(quantile_cont(jaccard, 0.5), 6) AS q50, round(quantile_cont(jaccard, 0.9), 6) AS q90, round(quantile_cont(jaccard, 0.99), 6) AS q99, round(avg(CAST(jaccard > 0 AS DOUBLE)), 6) AS positive_share, round(avg(CAST(jaccard >= 0.2 AS DOUBLE)), 6) AS similar_share,
        CAST(sum(CAST(jaccard = 1 AS INT)) AS BIGINT) AS identical_pairs, identical_keywords, round(md, 6) AS nearest_median, round(mx, 6) AS nearest_max FROM jac JOIN n USING (lang) GROUP BY jac.lang, identical_keywords, md, mx""")
def jaccard_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, kw, i = parts(spark, sf_dir)
    return sx.jaccard_summary(sx.access_jaccard(kw, sx.cooccurrence(i)))


@query(f"""WITH {oracle.cooc(K)}, f AS (SELECT lang, i, j, n FROM cooc UNION ALL SELECT lang, j, i, n FROM cooc), m AS (SELECT lang, i, sqrt(sum(n * n)) AS norm FROM f GROUP BY ALL),
    d AS (SELECT a.lang, a.i, b.i AS j, sum(a.n * b.n) AS dot FROM f a JOIN f b ON a.lang = b.lang AND a.j = b.j AND a.i < b.i GROUP BY ALL)
    SELECT x.lang, x.rank AS i, y.rank AS j, round(coalesce(dot / (mx.norm * my.norm), 0.0), 6) AS cosine FROM kw x JOIN kw y ON x.lang = y.lang AND x.rank < y.rank
    LEFT JOIN d ON d.lang = x.lang AND d.i = x.rank AND d.j = y.rank LEFT JOIN m mx ON mx.lang = x.lang AND mx.i = x.rank LEFT JOIN m my ON my.lang = x.lang AND my.i = y.rank""")
def cooccurrence_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, kw, i = parts(spark, sf_dir)
    return sx.cooccurrence_cosine(kw, written(sx.cooccurrence(i), "pairs")).withColumn("cosine", F.round("cosine", 6))


@query(f"""WITH {oracle.cooc(K)}, s AS (SELECT doc_id, lang, doc_id % 3 = 0 AS a FROM documents), n AS (SELECT lang, sum(CAST(a AS INT)) AS na, sum(CAST(NOT a AS INT)) AS nb FROM s GROUP BY lang),
    m AS (SELECT lang, rank, sum(CAST(a AS INT)) AS a, sum(CAST(NOT a AS INT)) AS b FROM inc JOIN s USING (lang, doc_id) GROUP BY ALL),
    p AS (SELECT x.lang, x.rank AS i, y.rank AS j, sum(CAST(a AS INT)) AS a, sum(CAST(NOT a AS INT)) AS b FROM inc x JOIN inc y ON x.lang = y.lang AND x.doc_id = y.doc_id AND x.rank < y.rank JOIN s ON s.doc_id = x.doc_id GROUP BY ALL),
    m1 AS (SELECT lang, sqrt(avg(pow(coalesce(a, 0) / na - coalesce(b, 0) / nb, 2))) AS r FROM kw LEFT JOIN m USING (lang, rank) JOIN n USING (lang) GROUP BY lang),
    m2 AS (SELECT x.lang, sqrt(avg(pow(coalesce(a, 0) / na - coalesce(b, 0) / nb, 2))) AS r FROM kw x JOIN kw y ON x.lang = y.lang AND x.rank < y.rank LEFT JOIN p ON p.lang = x.lang AND p.i = x.rank AND p.j = y.rank JOIN n ON n.lang = x.lang GROUP BY x.lang)
    SELECT m1.lang, round(m1.r, 6) AS marginal_rmse, round(m2.r, 6) AS cooccurrence_rmse FROM m1 JOIN m2 USING (lang)""")
def partition_rmse(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, kw, i = parts(spark, sf_dir)
    side = lambda df, a: df.where((F.col("doc_id") % 3 == 0) == F.lit(a))
    n = lambda a: side(docs, a).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    df = lambda a: side(i, a).groupBy("lang", "rank").agg(F.count(F.lit(1)).alias("df"))
    return sx.partition_rmse(n(True), df(True), n(False), df(False), sx.cooccurrence(side(i, True)), sx.cooccurrence(side(i, False)), kw)


_ROUNDED = ", ".join(f"round({f}, 6) AS {f}" for f in sx.FEATURES)


@query(f"WITH {oracle.TOK}, occ AS (SELECT doc_id, lang, unnest(list_distinct(t)) AS token FROM tok), docs AS (SELECT doc_id, lang FROM documents), {oracle.features(K)} SELECT lang, {_ROUNDED} FROM feat")
def primary_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scalars that sweeps relate to recovery, by language."""
    return sx.features(*parts(spark, sf_dir)).select("lang", *[F.round(f, 6).alias(f) for f in sx.FEATURES])


@query(f"WITH {oracle.keywords(K)}, l AS (SELECT lang, doc_id, doc_id || ':' || string_agg(rank, ',' ORDER BY rank) AS t, count(*) AS n FROM inc GROUP BY lang, doc_id), p AS (SELECT lang, doc_id // 65536 AS b, sha256(string_agg(t, chr(10) ORDER BY doc_id)) AS h, sum(n) AS n FROM l GROUP BY lang, doc_id // 65536) SELECT lang, CAST(sum(n) AS BIGINT) AS incidences, sha256(string_agg(h, chr(10) ORDER BY b)) AS sha256 FROM p GROUP BY lang")
def incidence_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sx.incidence_digest(parts(spark, sf_dir)[2])


#: keywords a language where products go by blocks
MANY = 2000


def _blocks(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    tok = inc.token_sets(table(spark, sf_dir, "documents"))
    return written(products.blocks_of_lists(inc.keyword_lists(tok, inc.top_keywords(tok, k))), "blocks")


@query(f"""WITH {oracle.cooc(MANY)}, f AS (SELECT lang, i, n FROM cooc UNION ALL SELECT lang, j, n FROM cooc)
    SELECT lang, i, count(*) AS partners, CAST(sum(n) AS BIGINT) AS together, max(n) AS most FROM f GROUP BY ALL""")
def keyword_partners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each of two thousand keywords a language that meets any other: how many it meets, how often, and the most with one."""
    pairs = products.pairs_of_blocks(_blocks(spark, sf_dir, MANY))
    both = pairs.select("lang", F.explode(F.array("i", "j")).alias("i"), "n")
    return both.groupBy("lang", "i").agg(F.count(F.lit(1)).alias("partners"), F.sum("n").alias("together"), F.max("n").alias("most"))


#: keywords a language where the SQL beside it can still join all profiles
SOME = 400


def _nearest(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    cos = products.profile_cosine(written(products.profile_products(_blocks(spark, sf_dir, k)), "products"))
    both = cos.select("lang", F.explode(F.array("i", "j")).alias("i"), "cosine")
    return both.groupBy("lang", "i").agg(F.count(F.lit(1)).alias("related"), F.round(F.max("cosine"), 6).alias("nearest"), F.round(F.sum("cosine") / (k - 1), 6).alias("mean_cosine"))


@query(f"""WITH {oracle.cooc(SOME)}, f AS (SELECT lang, i, j, n FROM cooc UNION ALL SELECT lang, j, i, n FROM cooc), m AS (SELECT lang, i, sqrt(sum(n * n)) AS norm FROM f GROUP BY ALL),
    d AS (SELECT a.lang, a.i, b.i AS j, sum(a.n * b.n) AS dot FROM f a JOIN f b ON a.lang = b.lang AND a.j = b.j AND a.i < b.i GROUP BY ALL),
    c AS (SELECT d.lang, d.i, d.j, dot / (mx.norm * my.norm) AS cosine FROM d JOIN m mx ON mx.lang = d.lang AND mx.i = d.i JOIN m my ON my.lang = d.lang AND my.i = d.j), b AS (SELECT lang, i, cosine FROM c UNION ALL SELECT lang, j, cosine FROM c)
    SELECT lang, i, count(*) AS related, round(max(cosine), 6) AS nearest, round(sum(cosine) / {SOME - 1}, 6) AS mean_cosine FROM b GROUP BY ALL""")
def nearest_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each of the top keywords: others whose profile of co-occurrence meets its own, the nearest one's cosine, and the mean over all others."""
    return _nearest(spark, sf_dir, SOME)


@query()
def nearest_profiles_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``nearest_profiles`` of two thousand keywords a language; the SQL's join of profiles does not fit its memory there. Tests hold the products against dense ones."""
    return _nearest(spark, sf_dir, MANY)
