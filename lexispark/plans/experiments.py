"""Queries of experiments: interventions, recovery costs and runs, and the statistics of repeated runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexispark.operators import controls
from lexispark.operators import incidence as inc
from lexispark.operators import interventions as iv
from lexispark.operators import matching, recovery
from lexispark.operators import statistics as stt
from lexispark.operators import structure as sx
from lexispark.plans import oracle
from lexispark.plans.structure import parts
from lexispark.registry import query, table
from lexispark.session import written

K = 40
_ALL = f"{oracle.keywords(K)}, e AS (SELECT lang, doc_id AS doc, rank AS kw FROM inc), d AS (SELECT lang, doc_id AS doc FROM documents)"
BY = ["lang"]


def by_language(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents (lang, doc) and the incidence (lang, doc, kw) of each language's top keywords, written."""
    docs, _, i = parts(spark, sf_dir, K)
    return docs.select("lang", F.col("doc_id").alias("doc")), written(i.select("lang", F.col("doc_id").alias("doc"), F.col("rank").alias("kw")), "incidence")


def counts(inc: DataFrame) -> DataFrame:
    """Frequency and a digest of the documents of each keyword."""
    return inc.groupBy("lang", "kw").agg(F.count(F.lit(1)).alias("df"), F.sum("doc").cast("long").alias("doc_sum"))


def pairs_of(docs: DataFrame, first: int, count: int) -> DataFrame:
    """In each language, donors of even and recipients of odd numbers: lang, donor, recipient."""
    two = F.explode(F.sequence(F.lit(first // 2).cast("long"), F.lit(first // 2 + count - 1).cast("long")))
    return docs.select("lang").distinct().withColumn("p", two).select("lang", (F.col("p") * 2).alias("donor"), (F.col("p") * 2 + 1).alias("recipient"))


def _frequency(inc: DataFrame) -> DataFrame:
    return inc.groupBy("lang", "kw").agg(F.count(F.lit(1)).alias("df"))


_SUM = "SELECT lang, kw, count(*) AS df, CAST(sum(doc) AS BIGINT) AS doc_sum FROM r GROUP BY lang, kw"
_COLLIDED = "r AS (SELECT lang, doc, kw FROM e WHERE NOT (kw % 2 = 1 AND kw < 10) UNION ALL SELECT lang, doc, kw + 1 FROM e WHERE kw % 2 = 0 AND kw < 10)"
_F = "f AS (SELECT lang, kw, count(*) AS df FROM e GROUP BY lang, kw)"


@query(f"WITH {_ALL}, {_COLLIDED} {_SUM}")
def forced_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, i = by_language(spark, sf_dir)
    return counts(iv.collide(i, pairs_of(docs, 0, 5), BY))


_THIN = "q AS (SELECT lang, doc, kw, row_number() OVER (PARTITION BY lang, kw ORDER BY sha256('3' || chr(10) || kw || chr(10) || doc), doc) AS k, count(*) OVER (PARTITION BY lang, kw) AS n FROM e)"


@query(f"""WITH {_ALL}, {_THIN}, r AS (SELECT lang, doc, kw FROM q WHERE k <= least(n, greatest(5, round_even(n * 0.25, 0)))) {_SUM}""")
def sparsity_thinning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts(iv.thin(by_language(spark, sf_dir)[1], 0.25, 5, 3, BY))


@query(f"""WITH {_ALL}, {_F}, p AS (SELECT a.lang, a.kw AS x, b.kw AS y, a.df AS a, b.df AS b, least(round_even(0.5 * (a.df + b.df) / 1.5, 0), a.df, b.df) AS k FROM f a JOIN f b ON a.lang = b.lang AND b.kw = a.kw + 1 AND a.kw % 2 = 0 AND a.kw >= 30),
       g AS (SELECT p.*, d.doc, EXISTS (SELECT 1 FROM e WHERE e.lang = p.lang AND e.doc = d.doc AND e.kw = p.x) AS own, sha256('4:similar' || chr(10) || x || chr(10) || y || chr(10) || d.doc) AS s FROM p JOIN d ON p.lang = d.lang),
       h AS (SELECT *, row_number() OVER (PARTITION BY lang, x, y, own ORDER BY s, doc) AS n FROM g), r AS (SELECT lang, doc, kw FROM e WHERE NOT (kw % 2 = 1 AND kw >= 30) UNION ALL SELECT lang, doc, y FROM h WHERE (own AND n <= k) OR (NOT own AND n <= b - k)) {_SUM}""")
def access_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, i = by_language(spark, sf_dir)
    return counts(iv.similar_access(i, docs, pairs_of(docs, 30, 5), 0.5, 4, BY))


@query(f"""WITH {_ALL}, {_F}, p AS (SELECT a.lang, a.kw AS x, b.kw AS y, (a.df + b.df) // 2 AS f FROM f a JOIN f b ON a.lang = b.lang AND b.kw = a.kw + 1 AND a.kw % 2 = 0 AND a.kw >= 30),
       h AS (SELECT p.lang, x, y, f, doc, row_number() OVER (PARTITION BY p.lang, x, y ORDER BY sha256('5:equal' || chr(10) || x || chr(10) || y || chr(10) || doc), doc) AS n FROM p JOIN d ON p.lang = d.lang),
       r AS (SELECT lang, doc, kw FROM e WHERE kw < 30 UNION ALL SELECT lang, doc, CASE WHEN n <= f THEN x ELSE y END FROM h WHERE n <= 2 * f) {_SUM}""")
def frequency_equalisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, i = by_language(spark, sf_dir)
    return counts(iv.equalise(i, docs, pairs_of(docs, 30, 5), 5, BY))


@query(f"""WITH {_ALL}, {_THIN}, m AS (SELECT lang, kw, count(*) AS x, CAST(sum(CAST(k <= least(n, greatest(5, round_even(n * CASE WHEN kw % 5 = 0 THEN 0.25 ELSE 0.5 END, 0))) AS INT)) AS BIGINT) AS y FROM q GROUP BY lang, kw)
       SELECT a.lang, a.kw AS i, b.kw AS j FROM m a JOIN m b ON a.lang = b.lang AND a.x > b.x AND a.y < b.y""")
def order_inversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth keyword is thinned to a quarter, the others to a half: that turns the order of some pairs round."""
    i = by_language(spark, sf_dir)[1]
    rate = F.when(F.col("kw") % 5 == 0, 0.25).otherwise(0.5)
    return iv.order_inversions(_frequency(i), _frequency(iv.thin(i, rate, 5, 3, BY)), BY)


@query(f"""WITH {_ALL}, o AS (SELECT lang, kw, row_number() OVER (PARTITION BY lang ORDER BY sha256('8' || chr(10) || kw), kw) AS r FROM (SELECT DISTINCT lang, kw FROM e)), z AS (SELECT unnest([10, 20, 40]) AS k)
       SELECT e.lang, CAST(k AS BIGINT) AS k, count(*) AS incidences, count(DISTINCT e.kw) AS keywords, count(DISTINCT doc) AS docs FROM z JOIN o ON r <= k JOIN e USING (lang, kw) GROUP BY e.lang, k""")
def keyword_size_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = by_language(spark, sf_dir)[1]
    o = controls.shuffled(i.select("lang", "kw").distinct(), 8, BY)
    sizes = o.select("lang", "kw", F.explode(F.filter(F.array(*[F.lit(k).cast("long") for k in (10, 20, 40)]), lambda k: F.col("rank") < k)).alias("k"))
    return i.join(F.broadcast(sizes), ["lang", "kw"]).groupBy("lang", "k").agg(F.count(F.lit(1)).alias("incidences"), F.countDistinct("kw").alias("keywords"), F.countDistinct("doc").alias("docs"))  # 3 K rows a language


_SIDES = "n AS (SELECT lang, sum(CAST(doc % 3 = 0 AS INT)) AS na, sum(CAST(doc % 3 <> 0 AS INT)) AS nc FROM d GROUP BY lang), f AS (SELECT lang, kw, CAST(sum(CAST(doc % 3 = 0 AS INT)) AS BIGINT) AS a, CAST(sum(CAST(doc % 3 <> 0 AS INT)) AS BIGINT) AS c FROM e GROUP BY lang, kw)"


def sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequencies of each keyword on both sides, and how many documents these have: lang, kw, aux, client, na, nc."""
    docs, i = by_language(spark, sf_dir)
    a = (F.col("doc") % 3 == 0).cast("long")
    n = docs.groupBy("lang").agg(F.sum(a).alias("na"), F.sum(1 - a).alias("nc"))
    return written(i.groupBy("lang", "kw").agg(F.sum(a).alias("aux"), F.sum(1 - a).alias("client")).join(n, "lang"), "sides")


@query(f"""WITH {_ALL}, {_SIDES} SELECT f.lang, kw, a AS auxiliary_df, c AS client_df, CASE WHEN a = 0 OR a = na OR c = 0 OR c = nc THEN 'unsupported' ELSE 'supported' END AS support FROM f JOIN n USING (lang)""")
def volume_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each keyword is in some but not all documents on both sides."""
    bad = (F.col("aux") == 0) | (F.col("aux") == F.col("na")) | (F.col("client") == 0) | (F.col("client") == F.col("nc"))
    return sides(spark, sf_dir).select("lang", "kw", F.col("aux").alias("auxiliary_df"), F.col("client").alias("client_df"), F.when(bad, "unsupported").otherwise("supported").alias("support"))


@query(f"""WITH {_ALL}, {_SIDES} SELECT t.lang, t.kw AS token, k.kw AS keyword, round(-t.c * ln(k.a / na) - (nc - t.c) * ln(1 - k.a / na), 4) AS cost FROM f t JOIN f k ON t.lang = k.lang JOIN n ON n.lang = t.lang WHERE k.a > 0 AND k.a < na""")
def initial_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = sides(spark, sf_dir)
    t, k = f.select("lang", F.col("kw").alias("token"), "client", "nc"), f.select("lang", F.col("kw").alias("keyword"), "aux", "na")
    return t.join(k, "lang").where("aux > 0 and aux < na").select("lang", "token", "keyword", F.round(recovery.initial_cost(F.col("client"), F.col("nc"), F.col("aux") / F.col("na")), 4).alias("cost"))  # K x K a language


_SUPPORTED = f"""{oracle.FREQ}, nn AS (SELECT lang, sum(CAST(doc_id % 3 = 0 AS INT)) AS na, sum(CAST(doc_id % 3 <> 0 AS INT)) AS nc FROM documents GROUP BY lang),
    xs AS (SELECT lang, token, sum(CAST(doc_id % 3 = 0 AS INT)) AS xa, sum(CAST(doc_id % 3 <> 0 AS INT)) AS xc FROM occ GROUP BY ALL),
    kw AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY xa + xc DESC, token) - 1 AS rank, token, CAST(xa + xc AS BIGINT) AS df FROM xs JOIN nn USING (lang) WHERE xa > 0 AND xa < na AND xc > 0 AND xc < nc QUALIFY rank < {K}),
    inc AS (SELECT occ.lang, doc_id, rank FROM occ JOIN kw USING (lang, token)), e AS (SELECT lang, doc_id AS doc, rank AS kw FROM inc), d AS (SELECT lang, doc_id AS doc FROM documents)"""


@query(f"WITH {_SUPPORTED} SELECT lang, rank, token, df FROM kw")
def supported_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent keywords of those that some but not all documents of both sides hold."""
    return inc.top_keywords(inc.token_sets(table(spark, sf_dir, "documents")), K, auxiliary=F.col("doc_id") % 3 == 0)


def pair_counts(spark: SparkSession, sf_dir: str, k: int = K) -> DataFrame:
    """lang, i, j (i <= j), aux, client, n_aux, n_client: documents of each side with both of two supported keywords."""
    tok = inc.token_sets(table(spark, sf_dir, "documents"))
    kw = written(inc.top_keywords(tok, k, auxiliary=F.col("doc_id") % 3 == 0), "keywords")
    docs = table(spark, sf_dir, "documents").select("lang", F.col("doc_id").alias("doc"))
    i = inc.incidence(tok, kw).select("lang", F.col("doc_id").alias("doc"), F.col("rank").alias("kw"))
    a = (F.col("doc") % 3 == 0).cast("long")
    sets = i.groupBy("lang", "doc").agg(F.sort_array(F.collect_list("kw")).alias("r"))  # K a document
    both = sets.select("lang", "doc", F.posexplode("r").alias("p", "i"), "r").select("lang", "doc", "i", F.explode(F.slice("r", F.col("p") + 1, F.size("r"))).alias("j"))
    n = docs.groupBy("lang").agg(F.sum(a).alias("n_aux"), F.sum(1 - a).alias("n_client"))
    return written(both.groupBy("lang", "i", "j").agg(F.sum(a).alias("aux"), F.sum(1 - a).alias("client")).join(n, "lang"), "pair-counts")


@query(f"""WITH {_SUPPORTED}, {_SIDES}, m AS (SELECT a.lang, a.kw AS i, b.kw AS j, sum(CAST(a.doc % 3 = 0 AS INT)) AS a, sum(CAST(a.doc % 3 <> 0 AS INT)) AS c FROM e a JOIN e b ON a.lang = b.lang AND a.doc = b.doc GROUP BY ALL),
       w AS (SELECT *, CASE WHEN lang = 'en' AND (i + j) % 7 = 0 AND i <> j THEN 0 ELSE a END AS z FROM m), fixed AS (SELECT DISTINCT lang, kw AS keyword, 39 - kw % 10 AS token FROM f WHERE kw >= 30),
       free AS (SELECT lang, kw FROM f WHERE kw < 30), grid AS (SELECT free.lang, free.kw, x.keyword AS of_keyword, x.token AS of_token FROM free JOIN fixed x USING (lang)),
       p AS (SELECT g.lang, g.kw AS keyword, g.of_keyword, coalesce(w.z, 0) / na AS p FROM grid g LEFT JOIN w ON w.lang = g.lang AND w.i = g.kw AND w.j = g.of_keyword JOIN n ON n.lang = g.lang),
       l AS (SELECT lang, of_keyword, min(p) FILTER (p > 0) AS least FROM p GROUP BY ALL), ps AS (SELECT p.lang, keyword, of_keyword, CASE WHEN p > 0 THEN p ELSE coalesce(least / 100, 1e-10) END AS p FROM p JOIN l USING (lang, of_keyword)),
       c AS (SELECT g.lang, g.kw AS token, g.of_keyword, coalesce(w.c, 0) AS c, nc FROM grid g LEFT JOIN w ON w.lang = g.lang AND w.i = g.kw AND w.j = g.of_token JOIN n ON n.lang = g.lang),
       o AS (SELECT t.lang, t.kw AS token, k.kw AS keyword, -t.c * ln(k.a / na) - (nc - t.c) * ln(1 - k.a / na) AS cost FROM f t JOIN f k ON t.lang = k.lang JOIN n ON n.lang = t.lang WHERE t.kw < 30 AND k.kw < 30),
       s AS (SELECT c.lang, token, keyword, sum(-c * ln(p) - (nc - c) * ln(1 - p)) AS cost FROM c JOIN ps USING (lang, of_keyword) GROUP BY ALL)
       SELECT lang, token, keyword, round(o.cost + s.cost, 3) AS cost FROM o JOIN s USING (lang, token, keyword)""")
def pair_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costs with ten fixed pairs of each language; in English a seventh of the pairs count as never seen together, so zeros occur."""
    half = pair_counts(spark, sf_dir)
    unseen = (F.col("lang") == "en") & ((F.col("i") + F.col("j")) % 7 == 0) & (F.col("i") != F.col("j"))
    half = half.withColumn("aux", F.when(unseen, F.lit(0).cast("long")).otherwise(F.col("aux")))
    swapped = half.where("i <> j").select("lang", F.col("j").alias("i"), F.col("i").alias("j"), "aux", "client", "n_aux", "n_client")
    fixed = half.where("i = j and i >= 30").select("lang", F.col("i").alias("keyword"), (39 - F.col("i") % 10).alias("token"))
    return recovery.pair_costs(written(half.unionByName(swapped), "pair-counts"), fixed, BY).select("lang", "token", "keyword", F.round("cost", 3).alias("cost"))


def _tasks(pairs: DataFrame) -> DataFrame:
    """Three distributions and four seeds for every dataset."""
    kinds = F.explode(F.array(*[F.struct(F.lit(d).alias("distribution"), F.lit(s).cast("long").alias("seed")) for d in ("each", "uniform_iid", "zipf_iid") for s in range(4)])).alias("t")
    return pairs.select("dataset").distinct().select("dataset", kinds).select("dataset", "t.distribution", "t.seed")


@query()
def recovery_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs over every language, each with as many keywords as its documents support, forty at most."""
    pairs = pair_counts(spark, sf_dir).withColumnRenamed("lang", "dataset")
    return recovery.recovery_runs(pairs, _tasks(pairs), 60, 0.25, [0, 10, 60])


@query(f"""WITH {_SUPPORTED}, n AS (SELECT lang AS dataset, count(*) AS k FROM kw GROUP BY lang), s AS (SELECT unnest([0, 1, 2, 3]) AS seed),
       each AS (SELECT dataset, 'each' AS distribution, seed, row_number() OVER (PARTITION BY dataset, seed ORDER BY sha256(seed || chr(10) || 'each' || chr(10) || keyword), keyword) - 1 AS position, keyword
                FROM (SELECT dataset, seed, unnest(range(k)) AS keyword FROM n, s)),
       p AS (SELECT dataset, distribution, k, unnest(range(k)) AS keyword FROM n, (SELECT unnest(['uniform_iid', 'zipf_iid']) AS distribution)),
       w AS (SELECT *, CASE distribution WHEN 'zipf_iid' THEN 1.0::DOUBLE / (keyword + 1) ELSE 1.0::DOUBLE END AS w FROM p),
       c AS (SELECT dataset, distribution, keyword, CASE WHEN keyword = k - 1 THEN 1.0 ELSE sum(w) OVER (PARTITION BY dataset, distribution ORDER BY keyword) / sum(w) OVER (PARTITION BY dataset, distribution) END AS high FROM w),
       dr AS (SELECT dataset, distribution, seed, position, CAST('0x' || substr(sha256(seed || chr(10) || distribution || chr(10) || position), 1, 13) AS BIGINT) / 4503599627370496.0 AS u
             FROM (SELECT dataset, distribution, seed, unnest(range(2 * k)) AS position FROM n, s, (SELECT unnest(['uniform_iid', 'zipf_iid']) AS distribution)))
       SELECT * FROM each UNION ALL SELECT dr.dataset, dr.distribution, dr.seed, dr.position, min(c.keyword) AS keyword FROM dr JOIN c ON c.dataset = dr.dataset AND c.distribution = dr.distribution AND dr.u < c.high GROUP BY ALL""")
def drawn_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queries of every run of ``recovery_runs``, in the three distributions."""
    pairs = pair_counts(spark, sf_dir).withColumnRenamed("lang", "dataset")
    return recovery.drawn_queries(_tasks(pairs), pairs.groupBy("dataset").agg((F.max("j") + 1).alias("k")))


_RUNS = "runs AS (SELECT event_type AS condition, user_id % 12 AS seed, avg(value) AS score FROM events GROUP BY ALL)"


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as runs: condition, seed, score."""
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("condition"), (F.col("user_id") % 12).alias("seed")).agg(F.avg("value").alias("score"))


_T = ", ".join(f"({i}, {stt.t_critical(i)!r})" for i in range(1, 31))


@query(f"""WITH {_RUNS}, t(df, t) AS (VALUES {_T}), s AS (SELECT condition, count(*) AS n, avg(score) AS mean, stddev_samp(score) AS sd, min(score) AS lo, max(score) AS hi FROM runs GROUP BY condition)
       SELECT condition, n, round(mean, 6) AS mean, round(sd, 6) AS sd, round(mean - t * sd / sqrt(n), 6) AS low, round(mean + t * sd / sqrt(n), 6) AS high, round(lo, 6) AS "min", round(hi, 6) AS "max" FROM s LEFT JOIN t ON df = n - 1""")
def run_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stt.summary(runs(spark, sf_dir), ["condition"], "score")
    return s.select("condition", "n", *[F.round(c, 6).alias(c) for c in ("mean", "sd", "low", "high", "min", "max")])


_DIFF = f"{_RUNS}, base AS (SELECT min(condition) AS b FROM runs), d AS (SELECT x.condition, x.seed, x.score - y.score AS difference FROM runs x JOIN runs y USING (seed) JOIN base ON y.condition = b AND x.condition <> b)"


def _paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = runs(spark, sf_dir)
    return stt.paired(r, [], "seed", "condition", r.agg(F.min("condition")).first()[0], "score")


@query(f"WITH {_DIFF} SELECT condition, seed, round(difference, 6) AS difference FROM d")
def paired_contrasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paired(spark, sf_dir).select("condition", "seed", F.round("difference", 6).alias("difference"))


_FLIP = f"""{_DIFF}, k AS (SELECT condition, difference AS x, row_number() OVER (PARTITION BY condition ORDER BY seed) - 1 AS k, count(*) OVER (PARTITION BY condition) AS n FROM d),
    m AS (SELECT condition, m, n, sum(CASE WHEN (m >> CAST(k AS INT)) & 1 = 1 THEN x ELSE -x END) / n AS mean FROM k, range(4096) r(m) WHERE m < (1 << CAST(n AS INT)) GROUP BY condition, m, n), o AS (SELECT condition, avg(difference) AS mean FROM d GROUP BY condition),
    p AS (SELECT condition, n, o.mean, avg(CAST(abs(m.mean) >= abs(o.mean) - 1e-12 AS DOUBLE)) AS p FROM m JOIN o USING (condition) GROUP BY condition, n, o.mean)"""


@query(f"""WITH {_FLIP}, r AS (SELECT *, row_number() OVER (ORDER BY p, condition) AS k, count(*) OVER () AS m FROM p)
       SELECT condition, n, round(mean, 6) AS mean, round(p, 9) AS p, round(2 / pow(2, n), 9) AS resolution, round(max(least(1.0, p * (m - k + 1))) OVER (ORDER BY k), 9) AS adjusted FROM r""")
def sign_flip_holm(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = stt.sign_flip(_paired(spark, sf_dir), ["condition"], "seed", "difference").withColumn("family", F.lit("all"))
    return stt.holm(p, ["family"], "p", ["condition"]).select("condition", "n", F.round("mean", 6).alias("mean"), F.round("p", 9).alias("p"), F.round("resolution", 9).alias("resolution"), F.round("adjusted", 9).alias("adjusted"))


_SIGNED = " + ".join(f"((r.m >> {i}) & 1) * d[{i + 1}]" for i in range(24))


@query(f"""WITH e AS (SELECT event_type AS condition, user_id % 24 AS seed, avg(value) AS v FROM events GROUP BY ALL), b AS (SELECT seed, avg(v) AS v FROM e GROUP BY seed),
       g AS (SELECT condition, list(e.v - b.v ORDER BY seed) AS d, sum(e.v - b.v) AS s, count(*) AS n FROM e JOIN b USING (seed) GROUP BY condition),
       x AS (SELECT condition, n, s, count(*) FILTER (abs(2 * ({_SIGNED}) - s) >= abs(s) - 1e-12) AS hits FROM g, range(16777216) r(m) GROUP BY condition, n, s)
       SELECT condition, n, round(s / n, 6) AS mean, round(hits / 16777216.0, 12) AS p FROM x""")
def sign_flip_24(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact sign flips of 24 runs: each condition against the mean of all, seed by seed."""
    e = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("condition"), (F.col("user_id") % 24).alias("seed")).agg(F.avg("value").alias("v"))
    b = e.groupBy("seed").agg(F.avg("v").alias("b"))
    p = stt.sign_flip(e.join(b, "seed").withColumn("difference", F.col("v") - F.col("b")), ["condition"], "seed", "difference")
    return p.select("condition", "n", F.round("mean", 6).alias("mean"), F.round("p", 12).alias("p"))


def _p_sql(r: str) -> str:
    """Student's p of a correlation in closed form; a term of the series by gamma functions."""
    even = f"1 - abs({r}) * (SELECT sum(exp(lgamma(k + 0.5) - lgamma(0.5) - lgamma(k + 1.0)) * pow(1 - {r} * {r}, k)) FROM range((n - 2) // 2) t(k))"
    odd = f"1 - 2 / pi() * (asin(abs({r})) + abs({r}) * coalesce((SELECT sum(exp(lgamma(k + 1.0) + lgamma(0.5) - lgamma(k + 1.5)) / 2 * pow(1 - {r} * {r}, k + 0.5)) FROM range((n - 3) // 2) t(k)), 0))"
    return f"CASE WHEN n % 2 = 0 THEN {even} ELSE {odd} END"


@query(f"""WITH f AS (SELECT event_type AS condition, user_id, avg(value) AS x, count(*) AS y FROM events GROUP BY ALL), r AS (SELECT *, rank() OVER (PARTITION BY condition ORDER BY x) + (count(*) OVER (PARTITION BY condition, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY condition ORDER BY y) + (count(*) OVER (PARTITION BY condition, y) - 1) / 2 AS ry FROM f),
       c AS (SELECT condition, count(*) AS n, corr(x, y) AS pearson, corr(rx, ry) AS spearman FROM r GROUP BY condition) SELECT condition, n, round(pearson, 6) AS pearson, round({_p_sql('pearson')}, 6) AS pearson_p, round(spearman, 6) AS spearman, round({_p_sql('spearman')}, 6) AS spearman_p FROM c""")
def correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    f = e.groupBy(F.col("event_type").alias("condition"), "user_id").agg(F.avg("value").alias("x"), F.count(F.lit(1)).cast("double").alias("y"))
    return stt.correlations(f, ["condition"], "x", "y").select("condition", "n", *[F.round(c, 6).alias(c) for c in ("pearson", "pearson_p", "spearman", "spearman_p")])


@query(f"""WITH {_RUNS}, c AS (SELECT DISTINCT condition FROM runs), s AS (SELECT unnest(range(14)) AS seed)
       SELECT c.condition, CAST(s.seed AS BIGINT) AS seed FROM c CROSS JOIN s ANTI JOIN runs r ON r.condition = c.condition AND r.seed = s.seed""")
def remaining_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = runs(spark, sf_dir)
    tasks = r.select("condition").distinct().withColumn("seed", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(13).cast("long"))))
    return recovery.remaining(tasks, r, ["condition", "seed"])


@query("""WITH q AS (SELECT user_id % 12 AS seed, user_id % 7 AS q, value > 50 AS hit FROM events), k AS (SELECT seed, q, avg(CAST(hit AS DOUBLE)) AS a, count(*) AS n FROM q GROUP BY ALL)
       SELECT seed, round(sum(a * n) / sum(n), 6) AS query_weighted_recovery, round(avg(a), 6) AS distinct_keyword_macro_recovery, count(*) AS observed_keywords FROM k GROUP BY seed""")
def recovery_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "events").select((F.col("user_id") % 12).alias("seed"), (F.col("user_id") % 7).alias("q"), (F.col("value") > 50).cast("double").alias("hit"))
    k = q.groupBy("seed", "q").agg(F.avg("hit").alias("a"), F.count(F.lit(1)).alias("n"))
    return k.groupBy("seed").agg(F.round(F.sum(F.col("a") * F.col("n")) / F.sum("n"), 6).alias("query_weighted_recovery"), F.round(F.avg("a"), 6).alias("distinct_keyword_macro_recovery"), F.count(F.lit(1)).alias("observed_keywords"))


@query(f"""WITH {_RUNS}, r2 AS (SELECT event_type AS condition, user_id % 12 AS seed, sum(value) / count(value) AS score FROM events GROUP BY ALL)
       SELECT condition, count(*) AS n, max(abs(runs.score - r2.score)) <= 1e-9 AS equal FROM runs JOIN r2 USING (condition, seed) GROUP BY condition""")
def replay_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    two = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("condition"), (F.col("user_id") % 12).alias("seed")).agg((F.sum("value") / F.count("value")).alias("again"))
    return runs(spark, sf_dir).join(two, ["condition", "seed"]).groupBy("condition").agg(F.count(F.lit(1)).alias("n"), (F.max(F.abs(F.col("score") - F.col("again"))) <= 1e-9).alias("equal"))


@query(f"""WITH {_RUNS} SELECT condition, array_to_string(list_sort(list(seed)), ',') AS seeds, count(*) = 12 AS complete FROM runs GROUP BY condition""")
def seed_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs(spark, sf_dir).groupBy("condition").agg(F.array_join(F.sort_array(F.collect_list("seed")), ",").alias("seeds"), (F.count(F.lit(1)) == 12).alias("complete"))


def _greedy_sql(edges: str, count: int) -> str:
    """SQL for disjoint pairs taken in order: ``edges`` has lang, l, r, score."""
    return f"""g AS ({edges}), o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score, l, r) AS k FROM g),
       s AS (SELECT lang, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS l, CAST(NULL AS BIGINT) AS r, CAST(NULL AS DOUBLE) AS score FROM (SELECT DISTINCT lang FROM o)
             UNION ALL SELECT s.lang, o.k, CASE WHEN list_has_any(used, [o.l, o.r]) THEN used ELSE list_concat(used, [o.l, o.r]) END, CASE WHEN list_has_any(used, [o.l, o.r]) THEN NULL ELSE o.l END, o.r, o.score
             FROM s JOIN o ON o.lang = s.lang AND o.k = s.k + 1)
       SELECT lang, l AS "left", r AS "right", score FROM s WHERE l IS NOT NULL QUALIFY row_number() OVER (PARTITION BY lang ORDER BY k) <= {count}"""


_RECURSIVE = _ALL.replace("tok AS (", "RECURSIVE tok AS (", 1)
_CLOSE = "SELECT a.lang, a.rank AS l, b.rank AS r, round_even(abs(ln(a.df / b.df)), 6) AS score FROM kw a JOIN kw b ON a.lang = b.lang AND a.rank < b.rank AND a.df <> b.df AND least(a.df, b.df) / greatest(a.df, b.df) >= 0.5"
_ENDS = "f a JOIN f b ON a.lang = b.lang AND a.kw < b.kw WHERE a.a > 0 AND b.a > 0 AND a.c > 0 AND b.c > 0 AND a.a <> b.a AND a.c <> b.c"


@query(f"WITH {_RECURSIVE}, {_greedy_sql(_CLOSE, 10)}")
def disjoint_keyword_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword pairs with unequal frequencies of similar size, no keyword twice, the ten closest of each language."""
    kw = parts(spark, sf_dir, K)[1].select("lang", "rank", "df")
    a, b = kw.select("lang", F.col("rank").alias("left"), F.col("df").alias("x")), kw.select("lang", F.col("rank").alias("right"), F.col("df").alias("y"))
    e = a.join(b, "lang").where("left < right and x <> y and least(x, y) / greatest(x, y) >= 0.5")  # K x K a language
    got = matching.disjoint_pairs(e, [F.bround(F.abs(F.ln(F.col("x") / F.col("y"))), 6), F.col("left"), F.col("right")], by=BY)
    place = F.row_number().over(Window.partitionBy("lang").orderBy("o0", "left", "right"))
    return got.withColumn("n", place).where("n <= 10").select("lang", "left", "right", F.col("o0").alias("score"))


@query(f"WITH {_ALL}, j AS (SELECT a.lang, a.kw AS i, b.kw AS j, count(*) AS n FROM e a JOIN e b ON a.lang = b.lang AND a.doc = b.doc AND b.kw = a.kw + 1 AND a.kw % 2 = 0 GROUP BY ALL), {_F} SELECT j.lang, i, j, round(n / (x.df + y.df - n), 6) AS jaccard FROM j JOIN f x ON x.lang = j.lang AND x.kw = i JOIN f y ON y.lang = j.lang AND y.kw = j")
def pair_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, kw, i = parts(spark, sf_dir, K)
    return sx.access_jaccard(kw, sx.cooccurrence(i)).where("j = i + 1 and i % 2 = 0 and jaccard > 0").select("lang", "i", "j", F.round("jaccard", 6).alias("jaccard"))


@query(f"""WITH {oracle.cooc(K)}, f AS (SELECT lang, i, j, n FROM cooc UNION ALL SELECT lang, j, i, n FROM cooc), m AS (SELECT lang, i, sqrt(sum(n * n)) AS norm FROM f GROUP BY ALL),
    d AS (SELECT a.lang, a.i, b.i AS j, sum(a.n * b.n) AS dot FROM f a JOIN f b ON a.lang = b.lang AND a.j = b.j AND b.i = a.i + 1 AND a.i % 2 = 0 GROUP BY ALL)
    SELECT d.lang, d.i, d.j, round(dot / (x.norm * y.norm), 6) AS cosine FROM d JOIN m x ON x.lang = d.lang AND x.i = d.i JOIN m y ON y.lang = d.lang AND y.i = d.j""")
def pair_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, kw, i = parts(spark, sf_dir, K)
    return sx.cooccurrence_cosine(kw, written(sx.cooccurrence(i), "pairs")).where("j = i + 1 and i % 2 = 0 and cosine > 0").select("lang", "i", "j", F.round("cosine", 6).alias("cosine"))


@query(f"WITH {_ALL}, k AS (SELECT DISTINCT lang, kw FROM e) SELECT lang, kw, row_number() OVER (PARTITION BY lang ORDER BY sha256('6' || chr(10) || kw), kw) - 1 AS rank FROM k")
def keyword_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return controls.shuffled(by_language(spark, sf_dir)[1].select("lang", "kw").distinct(), 6, BY)


@query(f"""WITH {_ALL}, {_F}, t AS (SELECT lang, kw, row_number() OVER (PARTITION BY lang ORDER BY df, kw) - 1 AS rank FROM f QUALIFY rank < 15) SELECT lang, t.rank AS kw, count(*) AS df, CAST(sum(doc) AS BIGINT) AS doc_sum FROM e JOIN t USING (lang, kw) GROUP BY lang, t.rank""")
def restricted_incidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifteen rarest keywords of each language, renumbered."""
    i = by_language(spark, sf_dir)[1]
    place = F.row_number().over(Window.partitionBy("lang").orderBy("df", "kw")) - 1
    terms = _frequency(i).withColumn("rank", place.cast("long")).where("rank < 15")
    return counts(controls.restrict(i, terms, BY))


@query(f"""WITH {oracle.FREQ}, n AS (SELECT lang, count(*) AS n FROM documents WHERE doc_id % 3 = 0 GROUP BY lang), a AS (SELECT lang, token, count(*) AS df FROM occ WHERE doc_id % 3 = 0 GROUP BY ALL) SELECT lang, token, df FROM a JOIN n USING (lang) WHERE df > 0 AND df < n""")
def auxiliary_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms that some but not all documents of the auxiliary side hold."""
    docs = table(spark, sf_dir, "documents").where("doc_id % 3 = 0")
    n = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    df = inc.document_frequency(inc.tokenised(docs)).join(F.broadcast(n), "lang")  # a row a language
    return controls.auxiliary_terms(df, F.col("n")).select("lang", "token", "df")


@query(f"""WITH {_RECURSIVE}, {_SIDES}, {_greedy_sql(f"SELECT a.lang, a.kw AS l, b.kw AS r, round_even(abs(ln(a.a / b.a)) + abs(ln(a.c / b.c)), 9) AS score FROM {_ENDS} AND least(a.a, b.a) / greatest(a.a, b.a) >= 0.5 AND least(a.c, b.c) / greatest(a.c, b.c) >= 0.5", 10)}""")
def similarity_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return controls.similarity_pairs(sides(spark, sf_dir), 10, 0.5, BY)


@query(f"""WITH {_RECURSIVE}, {_SIDES}, {_greedy_sql(f"SELECT a.lang, a.kw AS l, b.kw AS r, round_even(abs(a.a - b.a) / (a.a + b.a) + abs(a.c - b.c) / (a.c + b.c), 9) AS score FROM {_ENDS} AND (a.a + b.a) % 2 = 0 AND (a.c + b.c) % 2 = 0", 8)}""")
def equalisation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return controls.equalisation_pairs(sides(spark, sf_dir), 8, BY)


DRAWS = 8


@query(f"""WITH {_ALL}, {_F}, p AS (SELECT a.lang, a.kw AS x, b.kw AS y, b.df AS f FROM f a JOIN f b ON a.lang = b.lang AND b.kw = a.kw + 1 AND a.kw % 2 = 0 AND a.kw >= 30),
       g AS (SELECT p.*, d.doc, t.draw FROM p JOIN d ON d.lang = p.lang, range({DRAWS}) t(draw) WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.lang = p.lang AND e.doc = d.doc AND e.kw = p.x)),
       h AS (SELECT *, row_number() OVER (PARTITION BY lang, x, y, draw ORDER BY sha256('2:profile' || chr(10) || x || chr(10) || y || chr(10) || draw || chr(10) || doc), doc) AS n FROM g), k AS (SELECT * FROM h WHERE n <= f),
       u AS (SELECT k.lang, x, y, draw, e.kw, count(*) AS a FROM k JOIN e ON e.lang = k.lang AND e.doc = k.doc AND e.kw NOT IN (x, y) GROUP BY ALL), v AS (SELECT p.lang, x, y, b.kw, count(*) AS b FROM p JOIN e a ON a.lang = p.lang AND a.kw = x JOIN e b ON b.lang = a.lang AND b.doc = a.doc AND b.kw NOT IN (x, y) GROUP BY ALL),
       z AS (SELECT lang, x, y, sqrt(sum(b * b)) AS nb FROM v GROUP BY ALL), s AS (SELECT u.lang, u.x, u.y, draw, round_even(sum(a * coalesce(b, 0)) / (sqrt(sum(a * a)) * max(nb)), 9) AS cosine FROM u LEFT JOIN v USING (lang, x, y, kw) JOIN z USING (lang, x, y) GROUP BY ALL)
       SELECT p.lang, p.x AS donor, p.y AS recipient, CAST(draw AS INTEGER) AS draw, cosine, f AS df FROM p JOIN s USING (lang, x, y) QUALIFY row_number() OVER (PARTITION BY p.lang, p.x, p.y ORDER BY cosine DESC, draw) = 1""")
def cooccurrence_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, i = by_language(spark, sf_dir)
    return controls.cooccurrence_match(i, docs, pairs_of(docs, 30, 5), DRAWS, 2, BY)


@query()
def length_balanced_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations of two halves matched by the lengths of their first user and assistant turns."""
    from lexispark.functions.text import word_count

    c = table(spark, sf_dir, "conversations").where("role in ('user', 'assistant')")
    n = c.groupBy(F.col("conv_id").alias("id")).agg(F.min_by(word_count(F.col("text")), F.when(F.col("role") == "user", F.col("turn"))).alias("a"), F.min_by(word_count(F.col("text")), F.when(F.col("role") == "assistant", F.col("turn"))).alias("b"))
    return controls.length_matching(n.where("id % 2 = 0"), n.where("id % 2 = 1"), 1.5).withColumn("cost", F.round("cost", 9))


@query(f"""WITH {_RUNS}, l AS (SELECT condition, seed, seed % 3 AS level, score FROM runs), p AS (SELECT a.condition, b.score - a.score AS d FROM l a JOIN l b ON a.condition = b.condition AND a.level = 0 AND b.level = 2 AND b.seed = a.seed + 2)
       SELECT condition, count(*) AS n, round(avg(d), 6) AS mean, round(stddev_samp(d), 6) AS sd FROM p GROUP BY condition""")
def endpoint_contrasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = runs(spark, sf_dir).select("condition", (F.col("seed") % 3).alias("level"), F.floor(F.col("seed") / 3).alias("run"), "score")
    return stt.endpoint_contrasts(r, ["condition"], "run", "level", "score").select("condition", "n", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


@query(f"""WITH {_RUNS}, x AS (SELECT condition, avg(score) AS o FROM runs GROUP BY condition), y AS (SELECT event_type AS condition, avg(value) AS e FROM events GROUP BY ALL)
       SELECT condition, round(o, 6) AS observed, round(e, 6) AS expected, abs(o - e) <= 0.5 AS within FROM x JOIN y USING (condition)""")
def reference_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = runs(spark, sf_dir).groupBy("condition").agg(F.avg("score").alias("v"))
    e = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("condition")).agg(F.avg("value").alias("v"))
    return stt.within_tolerance(o, e, ["condition"], "v", 0.5).select("condition", F.round("observed", 6).alias("observed"), F.round("expected", 6).alias("expected"), "within")
