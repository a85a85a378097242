"""Queries of audits: checks of lists and run sets, review imports, task manifests, contrasts of conditions, sizes and partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexispark.functions import stemming as st
from lexispark.functions import text as tx
from lexispark.operators import controls, matching, policy, recovery
from lexispark.operators import incidence as inc
from lexispark.operators import interventions as iv
from lexispark.operators import statistics as stt
from lexispark.operators import structure as sx
from lexispark.plans import experiments as ex
from lexispark.plans import oracle
from lexispark.plans.corpus import _STOP_SQL, RULES, STOP, _sql_rules
from lexispark.plans.structure import parts
from lexispark.registry import query, table
from lexispark.session import written

_ALLOWED = ["exclude", "keep", "pending"]
_RETURNED = """ret AS (SELECT lang, CASE WHEN rank = 7 THEN token || 'x' ELSE token END AS token, CASE rank % 4 WHEN 0 THEN 'exclude' WHEN 1 THEN 'keep' WHEN 2 THEN 'pending' ELSE 'maybe' END AS decision FROM kw WHERE rank % 10 <> 9
    UNION ALL SELECT lang, token, 'keep' FROM kw WHERE rank = 5),
    per AS (SELECT lang, token, count(*) AS n, max(CAST(decision NOT IN ('exclude', 'keep', 'pending') AS INT)) AS bad, min(decision) AS d FROM ret GROUP BY ALL)"""


def _review(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A list of frequent words as issued, and as it came back with faults."""
    # forty words a language, found once for all that is made of them
    kw = written(inc.top_keywords(inc.tokenised(table(spark, sf_dir, "documents")), 40), "keywords")
    place = F.col("rank") % 4
    made = F.when(place == 0, "exclude").when(place == 1, "keep").when(place == 2, "pending").otherwise("maybe")
    back = kw.where("rank % 10 <> 9").select("lang", F.when(F.col("rank") == 7, F.concat("token", F.lit("x"))).otherwise(F.col("token")).alias("token"), made.alias("decision"))
    return kw.select("lang", "token"), back.union(kw.where("rank = 5").select("lang", "token", F.lit("keep")))


@query(f"""WITH {oracle.keywords(40)}, {_RETURNED}, b AS (SELECT coalesce(k.lang, p.lang) AS lang, coalesce(k.token, p.token) AS token, k.token IS NULL AS extra, n, bad FROM kw k FULL JOIN per p ON k.lang = p.lang AND k.token = p.token)
       SELECT lang, token, 'missing' AS reason FROM b WHERE n IS NULL UNION ALL SELECT lang, token, 'unexpected' FROM b WHERE extra UNION ALL SELECT lang, token, 'repeated' FROM b WHERE n > 1 UNION ALL SELECT lang, token, 'invalid' FROM b WHERE bad = 1""")
def review_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    issued, returned = _review(spark, sf_dir)
    return policy.set_errors(issued, returned, ["lang", "token"], F.col("decision").isin(*_ALLOWED))


@query(f"WITH {oracle.keywords(40)}, {_RETURNED} SELECT kw.lang, kw.token, CASE WHEN n = 1 AND bad = 0 THEN d ELSE 'pending' END AS decision FROM kw LEFT JOIN per USING (lang, token)")
def review_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    issued, returned = _review(spark, sf_dir)
    return policy.import_decisions(issued, returned, ["lang", "token"], "decision", _ALLOWED)


@query(f"""WITH {oracle.keywords(20)} SELECT lang AS language, rank, concat_ws(',', CASE WHEN lang NOT IN ('en', 'fr', 'de') THEN 'language' END, CASE WHEN rank % 6 = 1 THEN 'reviewer' END, CASE WHEN rank % 7 = 3 THEN 'token' END, CASE WHEN rank % 5 = 4 THEN 'pending' END) AS errors FROM kw""")
def stopword_list_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    kw = inc.top_keywords(inc.tokenised(table(spark, sf_dir, "documents")), 20)
    r = F.col("rank")
    e = kw.select(F.col("lang").alias("language"), "rank", F.when(r % 7 == 3, F.concat("token", F.lit("-x"))).otherwise(F.col("token")).alias("token"), F.when(r % 5 == 4, "pending").otherwise("exclude").alias("decision"), F.when(r % 6 != 1, "reader").otherwise("").alias("reviewed_by"))
    e = e.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("language", "token")))
    return e.select("language", "rank", F.array_join(policy.stopword_errors(["en", "fr", "de"]), ",").alias("errors"))


@query(f"""WITH {oracle.keywords(40)}, l AS (SELECT doc_id, list_sort(list(rank)) AS r FROM inc GROUP BY doc_id), x AS (SELECT doc_id, coalesce(r, CAST([] AS BIGINT[])) AS r FROM documents LEFT JOIN l USING (doc_id)),
       y AS (SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN list_reverse(r) ELSE r END AS r FROM x), z AS (SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN list_append(r, 40) ELSE r END AS r FROM y)
       SELECT doc_id, concat_ws(',', CASE WHEN r <> list_sort(list_distinct(r)) THEN 'order' END, CASE WHEN len(list_filter(r, lambda v: v < 0 OR v >= 40)) > 0 THEN 'range' END) AS errors FROM z""")
def export_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    tok = inc.tokenised(table(spark, sf_dir, "documents"))
    d = inc.export_documents(tok, inc.top_keywords(tok, 40))
    d = d.withColumn("keywords", F.when(F.col("doc_id") % 13 == 0, F.reverse("keywords")).otherwise(F.col("keywords")))
    d = d.withColumn("keywords", F.when(F.col("doc_id") % 17 == 0, F.array_append("keywords", F.lit(40).cast("long"))).otherwise(F.col("keywords")))
    return d.select("doc_id", F.array_join(policy.export_errors(40), ",").alias("errors"))


@query(f"""WITH {oracle.keywords(60)}, s AS (SELECT lang, count(*) AS docs, CAST(sum(CAST(doc_id % 3 = 0 AS INT)) AS BIGINT) AS auxiliary_docs, CAST(sum(CAST(doc_id % 3 <> 0 AS INT)) AS BIGINT) AS client_docs FROM documents GROUP BY lang),
       i AS (SELECT lang, count(*) AS incidences, count(DISTINCT rank) AS keywords FROM inc GROUP BY lang) SELECT lang, docs, auxiliary_docs, client_docs, keywords, incidences FROM s JOIN i USING (lang)""")
def export_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, _, i = parts(spark, sf_dir)
    a = (F.col("doc_id") % 3 == 0).cast("long")
    s = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), F.sum(a).alias("auxiliary_docs"), F.sum(1 - a).alias("client_docs"))
    return s.join(i.groupBy("lang", "rank").agg(F.count(F.lit(1)).alias("n")).groupBy("lang").agg(F.count(F.lit(1)).alias("keywords"), F.sum("n").alias("incidences")), "lang")


METRICS = ["available_count", "selected_count", "incidence_count", "matrix_density", "mean_document_length", "frequency_cv", "exact_alternative_share", "median_nearest_jaccard", "median_cosine"]
_CONDITIONS = f"""{oracle.TOK}, o AS (SELECT doc_id, lang, unnest(list_distinct(t)) AS token FROM tok), occ AS (SELECT doc_id, lang || ':token' AS lang, token FROM o UNION ALL SELECT doc_id, lang || ':stopword', token FROM o WHERE NOT list_contains({_STOP_SQL}, token)
    UNION ALL SELECT DISTINCT doc_id, lang || ':stemming', {_sql_rules()} FROM o), docs AS (SELECT doc_id, lang || ':' || unnest(['token', 'stopword', 'stemming']) AS lang FROM documents), {oracle.features(40)},
    m AS (SELECT split_part(lang, ':', 1) AS lang, split_part(lang, ':', 2) AS condition, a.n AS available_count, feat.* EXCLUDE (lang) FROM feat JOIN (SELECT lang, count(*) AS n FROM freq GROUP BY lang) a USING (lang))"""
_LESS = lambda a, b: ", ".join(f"round({a}.{n} - {b}.{n}, 6) AS {n}" for n in METRICS)


def condition_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lang, condition and the nine metrics, under plain tokens, without stopwords, and stemmed. One pass measures all: each condition of a language is a group."""
    docs = table(spark, sf_dir, "documents")
    every_token = inc.token_sets(docs)
    df = every_token.select("lang", F.explode("tokens").alias("token")).groupBy("lang", "token").agg(F.count(F.lit(1)).alias("df"))  # they are distinct
    words = written(df.withColumn("stem", st.suffix_stem(F.col("token"), RULES)), "words")
    stop = F.lit(False)
    for lang, listed in STOP.items():
        stop |= (F.col("lang") == lang) & F.col("token").isin(*listed)
    plain = words.where(~F.coalesce(stop, F.lit(False)))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("df"), "token"))
    first = lambda t: t.withColumn("rank", rank).where("rank <= 40")
    # only words that can be keywords of a condition are carried on
    leading = written(first(words).select("lang", "token").unionByName(first(plain).select("lang", "token")).unionByName(inc.stem_contenders(words, 40)).distinct(), "leading")
    tok = inc.restricted(every_token, leading)
    available = {"token": words.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "stopword": plain.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "stemming": words.groupBy("lang").agg(F.countDistinct("stem").alias("n"))}
    stem = F.array_distinct(F.transform("tokens", lambda t: st.suffix_stem(t, RULES)))
    made = {"token": tok, "stopword": inc.remove_stopwords(tok, STOP), "stemming": tok.withColumn("tokens", stem)}
    every = count = None
    for name, t in made.items():
        label = F.concat("lang", F.lit(f":{name}")).alias("lang")
        one, n = t.select("doc_id", label, "tokens"), available[name].select(label, F.col("n").alias("available_count"))
        every, count = (one, n) if every is None else (every.unionByName(one), count.unionByName(n))
    every = written(every, "conditions")
    kw = written(first(inc.document_frequency(every)).select("lang", (F.col("rank") - 1).cast("long").alias("rank"), "token", "df"), "keywords")
    f = sx.features(every.select("doc_id", "lang"), kw, inc.incidence(every, kw)).join(count, "lang")
    return written(f.select(F.split_part("lang", F.lit(":"), F.lit(1)).alias("lang"), F.split_part("lang", F.lit(":"), F.lit(2)).alias("condition"), *METRICS), "metrics")


@query(f"WITH {_CONDITIONS} SELECT m.lang, m.condition, {_LESS('m', 'b')} FROM m JOIN m b ON b.lang = m.lang AND b.condition = 'token' WHERE m.condition <> 'token'")
def condition_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structure under stopword removal and stemming, less that of plain tokens."""
    d = sx.metric_differences(condition_metrics(spark, sf_dir), ["lang"], "condition", "token", METRICS)
    return d.select("lang", "condition", *[F.round(n, 6).alias(n) for n in METRICS])


@query(f"WITH {_CONDITIONS} SELECT x.condition, {_LESS('x', 'y')} FROM m x JOIN m y ON x.condition = y.condition AND x.lang = 'fr' AND y.lang = 'en'")
def language_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structure of one language less that of another, under each condition."""
    d = sx.group_differences(condition_metrics(spark, sf_dir), ["condition"], "lang", "fr", "en", METRICS)
    return d.select("condition", *[F.round(n, 6).alias(n) for n in METRICS])


_SPLITS = "CASE doc_id % 50 WHEN 0 THEN ['auxiliary', 'client'] WHEN 1 THEN ['auxiliary', 'auxiliary'] WHEN 2 THEN ['client'] ELSE [CASE WHEN doc_id % 3 = 0 THEN 'auxiliary' ELSE 'client' END] END"


@query(f"""WITH d AS (SELECT doc_id FROM documents UNION ALL SELECT doc_id FROM documents WHERE doc_id % 70 = 5), s AS (SELECT CASE WHEN doc_id % 90 = 7 THEN -doc_id ELSE doc_id END AS doc_id, unnest({_SPLITS}) AS side FROM documents), n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY ALL),
       k AS (SELECT doc_id, max(k) AS most, count(*) AS sides FROM (SELECT doc_id, side, count(*) AS k FROM s GROUP BY ALL) GROUP BY ALL), b AS (SELECT coalesce(n.doc_id, k.doc_id) AS doc_id, n, most, sides FROM n FULL JOIN k ON n.doc_id = k.doc_id)
       SELECT doc_id, unnest(list_filter([CASE WHEN n > 1 THEN 'repeated' END, CASE WHEN n IS NULL THEN 'unknown' END, CASE WHEN most > 1 THEN 'named_twice' END, CASE WHEN sides > 1 THEN 'overlap' END], lambda x: x IS NOT NULL)) AS reason FROM b""")
def split_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers and split of an export, with faults of every kind."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    at = F.col("doc_id") % 50
    one = F.when(F.col("doc_id") % 3 == 0, "auxiliary").otherwise("client")
    lit = lambda *x: F.array(*map(F.lit, x))
    sides = F.when(at == 0, lit("auxiliary", "client")).when(at == 1, lit("auxiliary", "auxiliary")).when(at == 2, lit("client")).otherwise(F.array(one))
    split = d.select(F.when(F.col("doc_id") % 90 == 7, -F.col("doc_id")).otherwise(F.col("doc_id")).alias("doc_id"), F.explode(sides).alias("side"))
    return policy.split_errors(d.union(d.where("doc_id % 70 = 5")), split, "doc_id")


@query("""WITH d AS (SELECT unnest([source, lang, source || '/' || lang]) AS domain, n_chars FROM documents) SELECT domain, count(*) AS docs, CAST(sum(n_chars) AS BIGINT) AS chars, contains(domain, 'en') AS english, round(100.0 * count(*) / (SELECT count(*) FROM documents), 3) AS percent FROM d GROUP BY domain""")
def domain_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each of their domains; a document has several."""
    docs = table(spark, sf_dir, "documents")
    d = docs.select(F.explode(F.array("source", "lang", F.concat("source", F.lit("/"), "lang"))).alias("domain"), "n_chars")
    g = d.groupBy("domain").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_chars").alias("chars")).crossJoin(F.broadcast(docs.agg(F.count(F.lit(1)).alias("n"))))  # n is one row
    return g.select("domain", "docs", "chars", F.contains("domain", F.lit("en")).alias("english"), F.round(F.lit(100.0) * F.col("docs") / F.col("n"), 3).alias("percent"))


@query(f"WITH {oracle.FREQ} SELECT DISTINCT lang, token FROM occ WHERE doc_id % 3 = 0")
def auxiliary_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The word list of the auxiliary side alone, by language."""
    docs = table(spark, sf_dir, "documents")
    side = docs.where("doc_id % 3 = 0").select("doc_id")
    return inc.occurrences(inc.tokenised(docs.join(side, "doc_id", "left_semi"))).select("lang", "token").distinct()


@query("SELECT conv_id, min(turn) AS first, count(*) AS lines, sha256(string_agg(text, ' ' ORDER BY turn)) AS text_sha256 FROM conversations GROUP BY conv_id")
def grouped_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.grouped_lines(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text").select("conv_id", "first", "lines", F.sha2("text", 256).alias("text_sha256"))


@query("SELECT page_id, url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'language=en&split=' || CASE WHEN page_id % 2 = 0 THEN 'dev' ELSE 'devtest' END AS record_url FROM pages")
def record_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = F.when(F.col("page_id") % 2 == 0, F.lit("dev")).otherwise(F.lit("devtest"))
    return table(spark, sf_dir, "pages").select("page_id", tx.record_url(F.col("url"), F.lit("en"), split).alias("record_url"))


@query(f"WITH {ex._ALL}, k AS (SELECT DISTINCT lang, kw FROM e) SELECT a.lang, a.kw AS i, b.kw AS j FROM k a JOIN k b ON a.lang = b.lang AND a.kw < b.kw QUALIFY row_number() OVER (PARTITION BY a.lang ORDER BY sha256('9' || chr(10) || a.kw || chr(10) || b.kw), a.kw, b.kw) <= 100")
def sampled_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return controls.pair_sample(ex.by_language(spark, sf_dir)[1].select("lang", "kw").distinct(), 100, 9, ex.BY)


@query(f"""WITH {ex._ALL}, {ex._COLLIDED}, p AS (SELECT DISTINCT lang, 2 * i AS donor, 2 * i + 1 AS recipient FROM documents, range(5) t(i)),
       s AS (SELECT lang, donor, recipient, (SELECT count(*) FROM r WHERE r.lang = p.lang AND kw = donor) AS x, (SELECT count(*) FROM r WHERE r.lang = p.lang AND kw = recipient) AS y, (SELECT count(*) FROM e WHERE e.lang = p.lang AND kw = recipient) AS old, (SELECT count(*) FROM r a JOIN r b ON a.lang = b.lang AND a.doc = b.doc WHERE a.lang = p.lang AND a.kw = donor AND b.kw = recipient) AS n FROM p)
       SELECT lang, donor, recipient, n = x AND n = y AS identical, y = old AS preserved_df, x = y AS equal_df, n = 0 AS disjoint FROM s""")
def intervention_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = ex.by_language(spark, sf_dir)
    pairs = ex.pairs_of(docs, 0, 5)
    return iv.invariants(before, iv.collide(before, pairs, ex.BY), pairs, ex.BY)


_SEED = "sha256(family || ':' || dataset || ':' || distribution || ':' || seed)"


# the families of a study: what data each works on, its distributions and seeds (fixed values: the names)
FAMILIES = {
    "partition": {"kind": "export", "distributions": ["uniform_iid", "zipf_iid"], "seeds": "attack"}, "controlled": {"kind": "restricted", "distributions": ["uniform_iid", "zipf_iid"], "seeds": "attack"},
    "shuffled": {"kind": "shuffled", "distributions": ["zipf_iid"], "seeds": "attack"}, "balanced": {"kind": "balanced", "distributions": ["uniform_iid", "zipf_iid"], "seeds": "attack"},
    "original_extended": {"kind": "export", "distributions": ["uniform_iid", "zipf_iid"], "seeds": "extended"}, "independent": {"kind": "export", "distributions": ["uniform_iid", "zipf_iid"], "seeds": "attack"},
    "independent_trajectory": {"kind": "export", "distributions": ["uniform_iid", "zipf_iid"], "seeds": "one"}, "auxiliary_only": {"kind": "auxiliary", "distributions": ["uniform_iid", "zipf_iid"], "seeds": "attack"}, "auxiliary_shift": {"kind": "auxiliary", "distributions": ["uniform_iid", "zipf_iid"], "seeds": "attack"},
}
SEEDS = {"attack": [0, 1, 2, 3], "extended": list(range(8)), "one": [0]}
_FAMILY_ROWS = ", ".join(f"('{n}', '{f['kind']}', {f['distributions']!r}, {SEEDS[f['seeds']]!r})" for n, f in FAMILIES.items())


@query(f"""WITH f(family, kind, ds, ss) AS (VALUES {_FAMILY_ROWS}), k AS (SELECT unnest(['export', 'restricted', 'shuffled', 'balanced', 'auxiliary']) AS kind), d AS (SELECT kind, lang, count(*) AS n FROM documents, k GROUP BY ALL),
       x AS (SELECT family, kind || ':' || lang || ':k40' AS dataset, lang, ds, ss, kind FROM f JOIN d USING (kind)), y AS (SELECT family, dataset, lang, unnest(ds) AS distribution, ss, kind FROM x), t AS (SELECT family, dataset, lang, distribution, CAST(unnest(ss) AS BIGINT) AS seed, kind FROM y)
       SELECT family, dataset, 40 AS k, distribution, seed, CASE WHEN seed < 3 AND lang < 'es' AND kind <> 'auxiliary' THEN 'reuse' ELSE 'run' END AS action,
         CAST('0x' || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2) AS BIGINT) AS local_seed FROM (SELECT *, {_SEED} AS h FROM t)""")
def expanded_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of nine families over their data; runs of unchanged data are taken from the cache."""
    d = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    kinds = F.explode(F.array(*[F.lit(k) for k in ("export", "restricted", "shuffled", "balanced", "auxiliary")])).alias("kind")
    data = d.select("lang", "n", kinds).select("kind", F.lit(0).alias("partition"), F.col("lang").alias("language"), F.lit("token").alias("condition"), F.concat("kind", F.lit(":"), "lang", F.lit(":k40")).alias("dataset"), F.sha2(F.concat_ws(":", "kind", "lang", "n"), 256).alias("digest"))
    tasks = recovery.family_tasks(data, FAMILIES, SEEDS)
    kept = data.where("kind <> 'auxiliary'").select("dataset", F.when(F.col("language") < "es", F.col("digest")).otherwise("stale").alias("digest"), F.explode(F.array(F.lit("uniform_iid"), F.lit("zipf_iid"))).alias("distribution"))
    cache = kept.withColumn("seed", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))))
    t = recovery.expanded_tasks(tasks, cache)
    return t.select("family", "dataset", tx.keyword_size(F.col("dataset")).alias("k"), "distribution", "seed", "action", tx.local_seed(F.concat_ws(":", "family", "dataset", "distribution", "seed")).alias("local_seed"))


@query(f"""WITH {ex._RUNS}, g AS (SELECT * FROM runs WHERE seed <> 5 UNION ALL SELECT * FROM runs WHERE seed = 3), per AS (SELECT condition, seed, count(*) AS n, max(CAST(NOT score BETWEEN 0 AND 50 AS INT)) AS bad FROM g GROUP BY ALL),
       x AS (SELECT condition, unnest(range(11)) AS seed FROM (SELECT DISTINCT condition FROM runs)), b AS (SELECT coalesce(x.condition, p.condition) AS condition, coalesce(x.seed, p.seed) AS seed, x.seed IS NULL AS extra, n, bad FROM x FULL JOIN per p ON x.condition = p.condition AND x.seed = p.seed)
       SELECT condition, seed, 'missing' AS reason FROM b WHERE n IS NULL UNION ALL SELECT condition, seed, 'unexpected' FROM b WHERE extra UNION ALL SELECT condition, seed, 'repeated' FROM b WHERE n > 1 UNION ALL SELECT condition, seed, 'invalid' FROM b WHERE bad = 1""")
def run_set_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = ex.runs(spark, sf_dir)
    expected = r.select("condition").distinct().withColumn("seed", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(10).cast("long"))))
    return policy.set_errors(expected, r.where("seed <> 5").union(r.where("seed = 3")), ["condition", "seed"], F.col("score").between(0, 50))


@query(f"""WITH {ex._DIFF}, t(df, t) AS (VALUES {ex._T}), s AS (SELECT condition, count(*) AS n, avg(difference) AS mean, stddev_samp(difference) AS sd FROM d GROUP BY condition)
       SELECT condition, n, round(mean, 6) AS mean, round(mean - t * sd / sqrt(n), 6) AS low, round(mean + t * sd / sqrt(n), 6) AS high FROM s LEFT JOIN t ON df = n - 1""")
def seed_uncertainty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contrasts with the baseline of the same seeds, with their intervals."""
    s = stt.summary(ex._paired(spark, sf_dir), ["condition"], "difference")
    return s.select("condition", "n", *[F.round(c, 6).alias(c) for c in ("mean", "low", "high")])


@query("""WITH k AS (SELECT event_type AS condition, user_id % 12 AS seed, count(DISTINCT user_id % 37) AS k FROM events GROUP BY ALL) SELECT condition, min(k) AS fewest, max(k) AS most, round(avg(k), 6) AS mean FROM k GROUP BY condition""")
def query_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct keywords that the queries of a run touch: the fewest, the most and their mean."""
    q = table(spark, sf_dir, "events").select(F.col("event_type").alias("condition"), (F.col("user_id") % 12).alias("seed"), (F.col("user_id") % 37).alias("q")).distinct()
    k = q.groupBy("condition", "seed").agg(F.count(F.lit(1)).alias("k"))
    return k.groupBy("condition").agg(F.min("k").alias("fewest"), F.max("k").alias("most"), F.round(F.avg("k"), 6).alias("mean"))


@query("""WITH r AS (SELECT unnest(['original', 'part' || (user_id % 5)]) AS part, event_type AS condition, user_id % 12 AS seed, value FROM events), m AS (SELECT part, condition, seed, avg(value) AS score FROM r GROUP BY ALL), b AS (SELECT min(event_type) AS b FROM events)
       SELECT x.part, x.condition, count(*) AS n, round(avg(x.score - y.score), 6) AS mean FROM m x JOIN m y ON x.part = y.part AND x.seed = y.seed JOIN b ON y.condition = b.b AND x.condition <> b.b GROUP BY ALL""")
def partition_contrasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean contrast with the baseline in each partition and in the original whole."""
    e = table(spark, sf_dir, "events")
    whole = F.explode(F.array(F.lit("original"), F.concat(F.lit("part"), F.col("user_id") % 5)))
    m = e.select(whole.alias("part"), F.col("event_type").alias("condition"), (F.col("user_id") % 12).alias("seed"), "value").groupBy("part", "condition", "seed").agg(F.avg("value").alias("score"))
    d = stt.paired(m, ["part"], "seed", "condition", e.agg(F.min("event_type")).first()[0], "score")
    return d.groupBy("part", "condition").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("difference"), 6).alias("mean"))


@query(f"""WITH {ex._RUNS}, l AS (SELECT condition, seed // 3 AS run, seed % 3 AS level, score - lag(score) OVER (PARTITION BY condition, seed // 3 ORDER BY seed % 3) AS d FROM runs)
       SELECT condition, level, count(*) AS n, round(avg(d), 6) AS mean, round(stddev_samp(d), 6) AS sd FROM l WHERE d IS NOT NULL GROUP BY ALL""")
def adjacent_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = ex.runs(spark, sf_dir).select("condition", (F.col("seed") % 3).alias("level"), F.floor(F.col("seed") / 3).alias("run"), "score")
    return stt.adjacent_contrasts(r, ["condition"], "run", "level", "score").select("condition", "level", "n", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


@query(f"""WITH {ex._RUNS}, k AS (SELECT condition, seed <> 5 AS l, seed <> 7 AS r FROM runs) SELECT condition, CAST(sum(CAST(l AND r AS INT)) AS BIGINT) AS "both", CAST(sum(CAST(l AND NOT r AS INT)) AS BIGINT) AS left_only, CAST(sum(CAST(r AND NOT l AS INT)) AS BIGINT) AS right_only FROM k GROUP BY condition""")
def shared_run_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = ex.runs(spark, sf_dir)
    return stt.shared_keys(r.where("seed <> 5"), r.where("seed <> 7"), ["condition", "seed"], ["condition"])


_SUMMARY = "SELECT event_type AS condition, user_id % 4 AS part, user_id % 12 // 4 AS seed, avg(value) AS a, avg(CAST(value > 50 AS DOUBLE)) AS b FROM events GROUP BY ALL"


@query(f"""WITH r AS ({_SUMMARY}) SELECT condition, part, array_to_string(list_sort(list(seed)), ',') AS seeds, round(avg(a), 6) AS a_mean, round(stddev_samp(a), 6) AS a_sd, round(avg(b), 6) AS b_mean, round(stddev_samp(b), 6) AS b_sd FROM r GROUP BY ALL""")
def family_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both scores of each family and partition over its seeds, which must be complete."""
    e = table(spark, sf_dir, "events")
    r = e.groupBy(F.col("event_type").alias("condition"), (F.col("user_id") % 4).alias("part"), F.floor(F.col("user_id") % 12 / 4).alias("seed")).agg(F.avg("value").alias("a"), F.avg((F.col("value") > 50).cast("double")).alias("b"))
    s = stt.family_summaries(r, ["condition", "part"], "seed", ["a", "b"], [0, 1, 2])
    return s.select("condition", "part", F.array_join("seeds", ",").alias("seeds"), *[F.round(c, 6).alias(c) for c in ("a_mean", "a_sd", "b_mean", "b_sd")])


@query("""WITH r AS (SELECT event_type AS condition, user_id % 6 AS seed, user_id % 12 // 6 * 10 AS checkpoint, avg(value) AS a, avg(CAST(value > 50 AS DOUBLE)) AS b FROM events GROUP BY ALL)
       SELECT condition, checkpoint, count(*) AS n, round(avg(a), 6) AS a_mean, round(stddev_samp(a), 6) AS a_sd, round(avg(b), 6) AS b_mean, round(stddev_samp(b), 6) AS b_sd FROM r GROUP BY ALL""")
def checkpoint_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs that hold arrays of checkpoints and scores, summarised by checkpoint."""
    e = table(spark, sf_dir, "events")
    r = e.groupBy(F.col("event_type").alias("condition"), (F.col("user_id") % 6).alias("seed"), (F.floor(F.col("user_id") % 12 / 6) * 10).alias("c")).agg(F.avg("value").alias("a"), F.avg((F.col("value") > 50).cast("double")).alias("b"))
    kept = r.groupBy("condition", "seed").agg(F.sort_array(F.collect_list(F.struct("c", "a", "b"))).alias("s"))  # two checkpoints a run
    runs = kept.select("condition", "seed", F.col("s.c").alias("checkpoints"), F.transform("s", lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"))).alias("scores"))
    long = stt.by_checkpoint(runs, ["condition", "seed"])
    a, b = (stt.summary(long, ["condition", "checkpoint"], m).select("condition", "checkpoint", "n", F.round("mean", 6).alias(f"{m}_mean"), F.round("sd", 6).alias(f"{m}_sd")) for m in "ab")
    return a.join(b.drop("n"), ["condition", "checkpoint"])


@query("""WITH r AS (SELECT event_type AS condition, user_id % 12 // 4 AS checkpoint, avg(value) AS v FROM events GROUP BY ALL), w AS (SELECT event_type AS condition, avg(value) AS e FROM events GROUP BY ALL)
       SELECT condition, CAST(checkpoint AS INTEGER) AS place, round(v, 6) AS observed, round(e, 6) AS expected, abs(v - e) <= 1.0 AS within FROM r JOIN w USING (condition)""")
def checkpoint_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays of observed and expected values, compared place by place."""
    e = table(spark, sf_dir, "events").withColumnRenamed("event_type", "condition")
    o = e.groupBy("condition", F.floor(F.col("user_id") % 12 / 4).alias("c")).agg(F.avg("value").alias("v")).groupBy("condition").agg(F.transform(F.sort_array(F.collect_list(F.struct("c", "v"))), lambda s: s["v"]).alias("observed"))  # three
    x = e.groupBy("condition").agg(F.avg("value").alias("v")).select("condition", F.array("v", "v", "v").alias("expected"))
    return stt.array_tolerance(o, x, ["condition"], 1.0).select("condition", "place", F.round("observed", 6).alias("observed"), F.round("expected", 6).alias("expected"), "within")


@query(f"""WITH {ex._FLIP}, t(df, t) AS (VALUES {ex._T}), s AS (SELECT condition, count(*) AS k, stddev_samp(difference) AS sd FROM d GROUP BY condition), l AS (SELECT condition, avg(score) AS own FROM runs GROUP BY condition), b0 AS (SELECT avg(score) AS other FROM runs JOIN base ON condition = b)
       SELECT condition, n, round(own, 6) AS left_mean, round(other, 6) AS right_mean, round(mean, 6) AS mean, round(sd, 6) AS sd, round(mean - t * sd / sqrt(n), 6) AS low, round(mean + t * sd / sqrt(n), 6) AS high, round(CASE WHEN sd <> 0 THEN mean / sd END, 6) AS standardised, round(p, 9) AS p FROM p JOIN s USING (condition) JOIN l USING (condition), b0 JOIN t ON df = n - 1""")
def paired_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each condition against the baseline, run by run: both means, the difference with its interval, in units of its deviation, and its exact p."""
    r = ex.runs(spark, sf_dir)
    s = stt.paired_summary(r, [], "seed", "condition", r.agg(F.min("condition")).first()[0], "score")
    return s.select("condition", "n", *[F.round(c, 6).alias(c) for c in ("left_mean", "right_mean", "mean", "sd", "low", "high", "standardised")], F.round("p", 9).alias("p"))
