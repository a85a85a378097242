"""Queries over ``documents``: tokens, vocabularies, keyword exports, stopwords, stems, candidate lists, concordances."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexispark.functions import stemming as st
from lexispark.functions import text as tx
from lexispark.functions import udtf
from lexispark.operators import conditions, controls
from lexispark.operators import incidence as inc
from lexispark.operators.numbering import numbered
from lexispark.plans import oracle
from lexispark.registry import query, table
from lexispark.session import shared_dir, spread, temporary, written

STOP = {"en": ["the", "of", "and", "to", "in", "is", "that"], "fr": ["le", "la", "de", "un", "une", "et"], "de": ["der", "die", "das", "und", "ist"], "es": ["el", "la", "de", "que", "los"]}
MARKERS = ["the", "un", "der", "los"]
RULES = [st.Rule("ing", "", 3, 0, ("thing", "being")), st.Rule("ment", "", 3, 0), st.Rule("heit", "", 3, 0), st.Rule("keit", "", 3, 0), st.Rule("ly", "", 3, 1), st.Rule("ed", "", 3, 1), st.Rule("en", "", 3, 1), st.Rule("s", "", 3, 2), st.Rule("e", "", 3, 2)]


def _tok(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inc.tokenised(table(spark, sf_dir, "documents"))


def _sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct tokens, written: for queries that use them more than once."""
    return inc.token_sets(table(spark, sf_dir, "documents"))


def _sql_rules(also: str | None = None) -> str:
    whens = []
    for r in st.ordered(RULES):
        rest = f"substr(token, 1, length(token) - {len(r.suffix)}) || '{r.replacement}'"
        names = ", ".join(f"'{x}'" for x in r.exceptions)
        no = "".join(f" AND {c} NOT IN ({names})" for c in ("token", also) if c) if r.exceptions else ""
        whens.append(f"WHEN ends_with(token, '{r.suffix}') AND length(regexp_replace({rest}, '[^\\p{{L}}\\p{{M}}]', '', 'g')) >= {r.minimum}{no} THEN {rest}")
    return "CASE " + " ".join(whens) + " ELSE token END"


_STOP_SQL = "CASE lang " + " ".join(f"WHEN '{k}' THEN [{', '.join(repr(w) for w in v)}]" for k, v in STOP.items()) + " ELSE [] END"


@query(f"""WITH {oracle.TOK} SELECT doc_id, lang, CAST(len(t) AS BIGINT) AS token_count, CAST(len(list_distinct(t)) AS BIGINT) AS unique_token_count,
       sha256(array_to_string(t, chr(10))) AS token_sequence_sha256 FROM tok""")
def tokenise_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inc.document_summary(_tok(spark, sf_dir))


@query(f"WITH {oracle.keywords(100)} SELECT lang, rank, token, df FROM kw")
def top_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inc.top_keywords(_tok(spark, sf_dir), 100)


@query(f"""WITH {oracle.TOK}, occ AS (SELECT doc_id, unnest(list_distinct(t)) AS token FROM tok), f AS (SELECT token, count(*) AS df FROM occ GROUP BY ALL)
       SELECT row_number() OVER (ORDER BY token) - 1 AS idx, token, df FROM f WHERE df >= 5 AND df <= 0.5 * (SELECT count(*) FROM documents)""")
def vocabulary_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inc.vocabulary(_tok(spark, sf_dir), 5, 0.5)


@query(f"""WITH {oracle.keywords(100)}, l AS (SELECT doc_id, list_sort(list(rank)) AS r FROM inc GROUP BY doc_id)
       SELECT doc_id, lang, CAST(coalesce(len(r), 0) AS BIGINT) AS n, coalesce(array_to_string(r, ','), '') AS keywords FROM tok LEFT JOIN l USING (doc_id)""")
def export_keyword_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    tok = _sets(spark, sf_dir)
    out = inc.export_documents(tok, inc.top_keywords(tok, 100))
    return out.select("doc_id", "lang", F.size("keywords").cast("long").alias("n"), F.array_join("keywords", ",").alias("keywords"))


@query(f"""WITH {oracle.FREQ}, t AS (SELECT lang, count(*) AS docs, CAST(sum(len(t)) AS BIGINT) AS tokens FROM tok GROUP BY lang)
       SELECT lang, docs, tokens, count(*) AS types, CAST(sum(df) AS BIGINT) AS incidences, CAST(sum(CASE WHEN df = 1 THEN 1 ELSE 0 END) AS BIGINT) AS single, round(sum(df) / (docs * count(*)), 9) AS density
       FROM freq JOIN t USING (lang) GROUP BY lang, docs, tokens""")
def corpus_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    tok = written(_tok(spark, sf_dir).select("doc_id", "lang", F.size("tokens").cast("long").alias("n"), F.array_distinct("tokens").alias("tokens")), "tokens")
    per = tok.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("tokens"))
    df = inc.document_frequency(tok).groupBy("lang").agg(F.count(F.lit(1)).alias("types"), F.sum("df").alias("incidences"), F.sum((F.col("df") == 1).cast("long")).alias("single"))
    return per.join(df, "lang").withColumn("density", F.round(F.col("incidences") / (F.col("docs") * F.col("types")), 9))


@query(f"""WITH {oracle.TOK}, c AS (SELECT doc_id, lang, unnest(t) AS token FROM tok)
       SELECT lang, token, count(*) AS tf, count(DISTINCT doc_id) AS df FROM c GROUP BY ALL HAVING count(DISTINCT doc_id) >= 3""")
def corpus_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = _tok(spark, sf_dir).select("doc_id", "lang", F.explode("tokens").alias("token")).groupBy("lang", "token", "doc_id").agg(F.count(F.lit(1)).alias("k"))
    return per.groupBy("lang", "token").agg(F.sum("k").alias("tf"), F.count(F.lit(1)).alias("df")).where("df >= 3")


@query(f"""WITH {oracle.TOK}, k AS (SELECT doc_id, lang, t, list_filter(t, lambda x: NOT list_contains({_STOP_SQL}, x)) AS r FROM tok)
       SELECT doc_id, lang, CAST(len(t) - len(r) AS BIGINT) AS removed, CAST(len(r) AS BIGINT) AS kept, sha256(array_to_string(r, chr(10))) AS token_sequence_sha256 FROM k""")
def stopword_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inc.remove_stopwords(_tok(spark, sf_dir), STOP).select("doc_id", "lang", "removed", F.size("tokens").cast("long").alias("kept"), tx.sequence_sha256(F.col("tokens")).alias("token_sequence_sha256"))


@query(f"""WITH {oracle.FREQ}, n AS (SELECT lang, count(*) AS docs FROM documents GROUP BY lang)
       SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY df DESC, token) AS place, token, df, round(df / docs, 9) AS ratio FROM freq JOIN n USING (lang) QUALIFY place <= 200""")
def stopword_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    tok = _tok(spark, sf_dir)
    n = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("docs"))
    top = inc.top_keywords(tok, 200)
    return top.join(n, "lang").select("lang", (F.col("rank") + 1).alias("place"), "token", "df", F.round(F.col("df") / F.col("docs"), 9).alias("ratio"))


@query(f"WITH {oracle.FREQ} SELECT lang, token, {_sql_rules()} AS stem FROM freq")
def suffix_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inc.document_frequency(_tok(spark, sf_dir)).select("lang", "token", st.suffix_stem(F.col("token"), RULES).alias("stem"))


@query(f"""WITH RECURSIVE {oracle.FREQ}, s AS (SELECT lang, token AS first, token, '' AS was, 0 AS step FROM freq UNION ALL SELECT lang, first, {_sql_rules("first")} AS token, token AS was, step + 1 FROM s WHERE token <> was)
       SELECT lang, first AS token, token AS stem FROM s QUALIFY row_number() OVER (PARTITION BY lang, first ORDER BY step DESC) = 1""")
def repeated_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inc.document_frequency(_tok(spark, sf_dir)).select("lang", "token", st.repeated_suffix_stem(F.col("token"), RULES).alias("stem"))


@query(f"""WITH {oracle.FREQ}, g AS (SELECT lang, {_sql_rules()} AS stem, count(*) AS k FROM freq GROUP BY ALL)
       SELECT lang, CAST(sum(k) AS BIGINT) AS types, count(*) AS stems, CAST(sum(CASE WHEN k > 1 THEN 1 ELSE 0 END) AS BIGINT) AS merged_stems, CAST(sum(CASE WHEN k > 1 THEN k ELSE 0 END) AS BIGINT) AS merged_types FROM g GROUP BY lang""")
def stem_merge_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inc.stem_groups(inc.document_frequency(_tok(spark, sf_dir)), st.suffix_stem(F.col("token"), RULES))


TOKENISER = {"config_version": "1.0.0", "unicode_form": "NFC", "indexed_fields": ["title", "body"], "casefold": True, "minimum_letter_count": 2, "minimum_document_frequency": 3, "maximum_document_frequency_ratio": 0.4}


@query()
def english_stem_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with English stopwords removed and English words stemmed; those of other languages stay as they are."""
    c = conditions.Condition(TOKENISER | {"indexed_fields": ["body"]}, {"en": set(STOP["en"])}, {"en": st.english_stemmer()})
    out = c.documents(spread(table(spark, sf_dir, "documents").select("doc_id", "lang", F.col("text").alias("body")), "doc_id"))
    return out.select("doc_id", "lang", "removed", "changed", F.size("tokens").cast("long").alias("token_count"), tx.sequence_sha256(F.col("tokens")).alias("token_sequence_sha256"))


_STEM_ANY = f"CASE lang WHEN 'en' THEN ({_sql_rules()}) WHEN 'de' THEN ({_sql_rules()}) ELSE token END"


@query(f"""WITH {oracle.TOK}, k AS (SELECT doc_id, lang, unnest(list_filter(t, lambda x: NOT list_contains({_STOP_SQL}, x))) AS token FROM tok), s AS (SELECT DISTINCT doc_id, {_STEM_ANY} AS stem FROM k), v AS (SELECT stem AS token, count(*) AS df FROM s GROUP BY stem)
       SELECT row_number() OVER (ORDER BY token) - 1 AS idx, token, df FROM v WHERE df >= 3 AND df <= 0.4 * (SELECT count(*) FROM documents)""")
def condition_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocabulary of a whole condition: tokens, less stopwords, stemmed by rules in two languages, within bounds of frequency."""
    rule = st.rule_stemmer(RULES)
    c = conditions.Condition(TOKENISER | {"indexed_fields": ["body"]}, {k: set(v) for k, v in STOP.items()}, {"en": rule, "de": rule})
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", F.col("text").alias("body")), "doc_id")
    return c.vocabulary(written(c.documents(docs).select("doc_id", "lang", F.array_distinct("tokens").alias("tokens")), "condition"))


_RULED = ("de", "es", "fr")


def _written_condition(spark: SparkSession, tok: DataFrame) -> str:
    """The files of a stemming condition: its lists have the fifteen most frequent tokens of each language, its specifications the rules. Returns the place of the first file."""
    root = f"{shared_dir(spark)}/lexispark/condition-{uuid.uuid4().hex}"
    review = {"status": "approved", "scope": "all", "reviewed_by": "r", "reviewed_at": "2024-01-01"}
    words: dict[str, list[str]] = {}
    for r in inc.top_keywords(tok, 15).where("lang is not null").orderBy("lang", "rank").collect():  # fifteen words a language
        words.setdefault(r.lang, []).append(r.token)
    rules = [{"suffix": r.suffix, "replacement": r.replacement, "minimum_stem_letter_count": r.minimum, "priority": r.priority, "exceptions": list(r.exceptions)} for r in RULES]
    payloads = {
        "configs/tokens.json": TOKENISER | {"indexed_fields": ["body"]},
        "configs/stop.json": {"config_version": "1.0.0", "tokenisation_config": "configs/tokens.json", "required_scope": "all", "stopword_lists": {k: f"lists/{k}_stop.json" for k in words}},
        "configs/stem.json": {"config_version": "1.0.0", "stopword_condition": "configs/stop.json", "required_scope": "all", "stemmer_specifications": {k: f"lists/{k}_stem.json" for k in _RULED}},
    }
    payloads |= {f"lists/{k}_stop.json": review | {"language": k, "entries": [{"token": w, "decision": "exclude_from_index"} for w in v]} for k, v in words.items()}
    payloads |= {f"lists/{k}_stem.json": review | {"language": k, "algorithm": "suffix_strip_v1", "rules": rules} for k in _RULED}
    for name, payload in payloads.items():
        spark.createDataFrame([(json.dumps(payload),)], "value string").coalesce(1).write.text(f"{root}/{name}")
    temporary(spark, root)
    return f"{root}/configs/stem.json"


_STEM_RULED = f"CASE WHEN lang IN ('de', 'es', 'fr') THEN ({_sql_rules()}) ELSE token END"


@query(f"""WITH {oracle.keywords(15)}, stop AS (SELECT lang, list(token) AS s FROM kw GROUP BY lang), k AS (SELECT doc_id, tok.lang, t, list_filter(t, lambda x: NOT list_contains(coalesce(s, []), x)) AS kept FROM tok LEFT JOIN stop ON stop.lang = tok.lang),
       o AS (SELECT doc_id, lang, len(t) - len(kept) AS removed, kept, list_transform(kept, lambda token: {_STEM_RULED}) AS stems FROM k)
       SELECT doc_id, lang, removed, CAST(len(list_filter(list_zip(kept, stems), lambda z: z[1] <> z[2])) AS BIGINT) AS changed, CAST(len(stems) AS BIGINT) AS token_count, sha256(array_to_string(stems, chr(10))) AS token_sequence_sha256 FROM o""")
def loaded_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole condition from its files (settings, lists and specifications, each checked), run over all documents."""
    condition, _ = conditions.load_condition(spark, _written_condition(spark, _sets(spark, sf_dir)))
    out = condition.documents(spread(table(spark, sf_dir, "documents").select("doc_id", "lang", F.col("text").alias("body")), "doc_id"))
    return out.select("doc_id", "lang", "removed", "changed", F.size("tokens").cast("long").alias("token_count"), tx.sequence_sha256(F.col("tokens")).alias("token_sequence_sha256"))


@query(f"""WITH {oracle.FREQ}, p AS (SELECT lang, token, unnest(range(3, length(token))) AS n FROM freq), a AS (SELECT p.lang, p.token, max_by(f.token, p.n) AS expected FROM p JOIN freq f ON f.lang = p.lang AND f.token = substr(p.token, 1, p.n) GROUP BY ALL),
       e AS (SELECT freq.lang, ({_STEM_RULED.replace('lang IN', 'freq.lang IN').replace('token', 'freq.token')}) = coalesce(expected, freq.token) AS correct FROM freq LEFT JOIN a ON a.lang = freq.lang AND a.token = freq.token)
       SELECT coalesce(lang, 'all') AS language, count(*) AS items, CAST(sum(CAST(correct AS INT)) AS BIGINT) AS correct, round(avg(CAST(correct AS DOUBLE)), 6) AS accuracy FROM e GROUP BY ROLLUP (lang)""")
def attested_stem_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A condition's stems against annotations from the table: the longest beginning of a word, of three letters or more, that is a word of its language itself, else the word."""
    tok = _sets(spark, sf_dir)
    words = written(inc.document_frequency(tok).select("lang", "token"), "words")
    begin = words.select("lang", "token", F.explode(F.when(F.length("token") > 3, F.sequence(F.lit(3), F.length("token") - 1)).otherwise(F.array().cast("array<int>"))).alias("n"))
    begin = begin.withColumn("beginning", F.substring("token", F.lit(1), F.col("n"))).join(words.withColumnRenamed("token", "beginning"), ["lang", "beginning"], "left_semi")
    longest = begin.groupBy("lang", "token").agg(F.max_by("beginning", "n").alias("e"))
    annotations = words.join(longest, ["lang", "token"], "left").select(F.col("lang").alias("language"), "token", F.coalesce("e", "token").alias("expected_stem"))
    condition, _ = conditions.load_condition(spark, _written_condition(spark, tok))
    return condition.evaluate(annotations).select(F.coalesce("language", F.lit("all")).alias("language"), "items", "correct", F.round("accuracy", 6).alias("accuracy"))


_GUARDED = ("s", "e")


def _sql_guarded() -> str:
    whens = []
    for r in st.ordered(RULES):
        rest = f"substr(token, 1, length(token) - {len(r.suffix)})"
        no = " AND token NOT IN (" + ", ".join(f"'{x}'" for x in r.exceptions) + ")" if r.exceptions else ""
        known = " AND w IS NOT NULL" if r.suffix in _GUARDED else ""
        whens.append(f"WHEN ends_with(token, '{r.suffix}') AND length(regexp_replace({rest}, '[^\\p{{L}}]', '', 'g')) >= {r.minimum}{no}{known} THEN {rest}")
    return "CASE " + " ".join(whens) + " ELSE token END"


@query(f"""WITH RECURSIVE {oracle.TOK}, words AS (SELECT DISTINCT unnest(t) AS token FROM tok), s AS (SELECT token AS first, token, '' AS was, 0 AS step FROM words
       UNION ALL SELECT first, {_sql_guarded()} AS token, token AS was, step + 1 FROM (SELECT s.*, x.token AS w FROM s LEFT JOIN words x ON x.token = substr(s.token, 1, length(s.token) - 1) WHERE s.token <> was))
       SELECT first AS token, token AS stem FROM s QUALIFY row_number() OVER (PARTITION BY first ORDER BY step DESC) = 1""")
def guarded_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Guarded suffixes need a candidate among all words; candidates are joined with the vocabulary."""
    words = written(inc.document_frequency(_tok(spark, sf_dir), []).select("token"), "words")
    guarded = frozenset(_GUARDED)
    asked = words.select("token", F.explode(st.guarded_candidates(RULES, guarded, letters_only=True)(F.col("token"))).alias("candidate"))
    known = asked.join(words.withColumnRenamed("token", "candidate"), "candidate", "left_semi").groupBy("token").agg(F.collect_set("candidate").alias("known"))  # a word's length at most
    stem = st.guarded_stemmer(RULES, guarded, letters_only=True)
    return words.join(known, "token", "left").select("token", stem(F.col("token"), F.col("known")).alias("stem"))


@query(f"""WITH RECURSIVE {oracle.FREQ}, s AS (SELECT lang, token AS first, token, '' AS was, 0 AS step FROM freq UNION ALL SELECT lang, first, {_sql_rules("first")} AS token, token AS was, step + 1 FROM s WHERE token <> was),
       r AS (SELECT lang, first, token AS repeated FROM s QUALIFY row_number() OVER (PARTITION BY lang, first ORDER BY step DESC) = 1), o AS (SELECT lang, token, {_sql_rules()} AS once FROM freq), t AS (SELECT lang, token AS word, once, once AS token FROM o), w AS (SELECT lang, word, once, {_sql_rules()} AS twice FROM t)
       SELECT w.lang, word AS token, once, twice, repeated FROM w JOIN r ON r.lang = w.lang AND r.first = w.word WHERE once <> twice OR once <> repeated OR twice <> repeated""")
def stemmer_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types that three variants stem differently: the rules once, twice, and until nothing changes."""
    df = inc.document_frequency(_tok(spark, sf_dir)).select("lang", "token")
    df = df.withColumn("once", tx.bound(F.col("token"), lambda x: st.suffix_stem(x, RULES)))
    # the word is bound, else each mention of it in the second chain would hold the whole first one
    df = df.withColumn("twice", tx.bound(F.col("once"), lambda x: st.suffix_stem(x, RULES))).withColumn("repeated", st.repeated_suffix_stem(F.col("token"), RULES))
    return df.where("once <> twice or once <> repeated or twice <> repeated")


@query(f"""WITH {oracle.FREQ}, tf AS (SELECT lang, token, count(*) AS n FROM (SELECT lang, unnest(t) AS token FROM tok) GROUP BY ALL),
       s AS (SELECT lang, k, right(token, k) AS suffix, token, n FROM tf, range(2, 6) r(k) WHERE length(token) >= 6 AND length(token) - k >= 3 AND NOT regexp_matches(token, '[^\\p{{L}}]')),
       g AS (SELECT lang, k AS size, suffix, count(*) AS types, CAST(sum(n) AS BIGINT) AS occurrences, array_to_string(list_sort(list(token))[1:6], ' ') AS examples FROM s GROUP BY ALL HAVING count(*) >= 8)
       SELECT lang, size, suffix, types, occurrences, examples FROM g QUALIFY row_number() OVER (PARTITION BY lang, size ORDER BY types DESC, occurrences DESC, suffix) <= 10""")
def suffix_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most common suffixes of each length, with six of their words. The words are looked up for these suffixes alone, and ranks stop at six."""
    tf = _tok(spark, sf_dir).select("lang", F.explode("tokens").alias("token")).groupBy("lang", "token").agg(F.count(F.lit(1)).alias("n"))
    long = written(tf.where((F.length("token") >= 6) & ~F.col("token").rlike("[^\\p{L}]")), "long-words")
    cut = long.select("lang", "token", "n", F.explode(F.sequence(F.lit(2), F.lit(5))).alias("k")).where("length(token) - k >= 3").select("lang", F.col("k").cast("long").alias("size"), F.expr("right(token, k)").alias("suffix"), "token", "n")
    g = cut.groupBy("lang", "size", "suffix").agg(F.count(F.lit(1)).alias("types"), F.sum("n").alias("occurrences")).where("types >= 8")
    rank = F.row_number().over(Window.partitionBy("lang", "size").orderBy(F.desc("types"), F.desc("occurrences"), "suffix"))
    top = written(g.withColumn("r", rank).where("r <= 10").drop("r"), "suffixes")
    place = F.row_number().over(Window.partitionBy("lang", "size", "suffix").orderBy("token"))
    few = cut.join(F.broadcast(top.select("lang", "size", "suffix")), ["lang", "size", "suffix"]).withColumn("r", place).where("r <= 6")  # forty suffixes a language
    named = few.groupBy("lang", "size", "suffix").agg(F.array_join(F.sort_array(F.collect_list("token")), " ").alias("examples"))
    return top.join(named, ["lang", "size", "suffix"])


@query(f"""WITH {oracle.FREQ}, r AS (SELECT lang, token, df, row_number() OVER (PARTITION BY lang ORDER BY df DESC, token) AS p, count(*) OVER (PARTITION BY lang) AS n FROM freq)
       SELECT lang, token, df, CASE WHEN p <= 15 THEN 'head' ELSE 'middle' END AS band FROM r WHERE p <= 15 OR p BETWEEN n // 2 + 1 AND n // 2 + 15
       UNION ALL SELECT lang, token, df, 'infrequent' FROM (SELECT lang, token, df FROM r WHERE df BETWEEN 2 AND 10 AND p > 15 AND NOT p BETWEEN n // 2 + 1 AND n // 2 + 15 QUALIFY row_number() OVER (PARTITION BY lang ORDER BY df, token) <= 15)""")
def stratified_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = written(inc.document_frequency(_tok(spark, sf_dir)), "frequencies")
    n = df.groupBy(F.col("lang").alias("of")).agg(F.count(F.lit(1)).alias("n"))
    # no task holds a language's whole vocabulary: words are numbered within their frequency and first letters
    r = numbered(df, "p", F.struct(-F.col("df"), F.substring("token", 1, 2)), F.desc("df"), "token", within=["lang"]).withColumn("p", F.col("p") + 1)
    r = r.join(F.broadcast(n), F.col("lang").eqNullSafe(F.col("of")))  # a row a language
    mid = F.col("p").between(F.floor(F.col("n") / 2) + 1, F.floor(F.col("n") / 2) + 15)
    band = F.when(F.col("p") <= 15, "head").when(mid, "middle").when(F.col("df").between(2, 10), "infrequent")
    r = r.withColumn("band", band).where("band is not null")
    place = F.row_number().over(Window.partitionBy("lang", "band").orderBy("df", "token"))
    return r.withColumn("q", place).where("q <= 15").select("lang", "token", "df", "band")


@query(f"""WITH {oracle.FREQ}, c AS (SELECT lang, token, {_sql_rules()} <> token AS changed FROM freq)
       SELECT lang, changed, token, sha256('7' || chr(10) || lang || chr(10) || token) AS score FROM c QUALIFY row_number() OVER (PARTITION BY lang, changed ORDER BY score, token) <= 20""")
def heldout_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = inc.document_frequency(_tok(spark, sf_dir)).select("lang", "token", (st.suffix_stem(F.col("token"), RULES) != F.col("token")).alias("changed"), tx.stable_score(7, F.col("lang"), F.col("token")).alias("score"))
    rank = F.row_number().over(Window.partitionBy("lang", "changed").orderBy("score", "token"))
    return c.withColumn("r", rank).where("r <= 20").select("lang", "changed", "token", "score")


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
       c AS (SELECT doc_id, pos, trim(regexp_replace(raw, '\\s+', ' ', 'g')) AS line FROM l), t AS (SELECT unnest(['shall', 'moron', 'license', 'mit', 'idiot', 'version']) AS token),
       h AS (SELECT token, doc_id, pos, line FROM c JOIN t ON list_contains(regexp_extract_all(lower(line), '[\\p{L}\\p{M}\\p{Nd}]+'), token)),
       f AS (SELECT token, line, min({'d': doc_id, 'p': pos}) AS loc FROM h GROUP BY ALL)
       SELECT token, loc.d AS doc_id, CASE WHEN length(line) <= 180 THEN line ELSE rtrim(substr(line, 1, 179)) || '…' END AS line FROM f QUALIFY row_number() OVER (PARTITION BY token ORDER BY loc) <= 2""")
def concordance(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "raw")).withColumn("line", F.trim(F.regexp_replace("raw", "\\s+", " ")))
    wanted = F.array(*[F.lit(x) for x in ("shall", "moron", "license", "mit", "idiot", "version")])
    hit = lines.select("doc_id", "pos", "line", F.explode(F.array_intersect(F.regexp_extract_all(F.lower("line"), F.lit(f"{tx.WORDLIKE}+"), F.lit(0)), wanted)).alias("token"))
    first = hit.groupBy("token", "line").agg(F.min(F.struct("doc_id", "pos")).alias("at"))
    rank = F.row_number().over(Window.partitionBy("token").orderBy("at"))
    return first.withColumn("r", rank).where("r <= 2").select("token", "at.doc_id", tx.concordance_line(F.col("line")).alias("line"))


@query(f"""WITH {oracle.TOK}, m AS (SELECT lang, unnest({MARKERS}) AS marker, t FROM tok), d AS (SELECT lang, count(*) AS docs, CAST(sum(CASE WHEN list_has_any(t, {MARKERS}) THEN 1 ELSE 0 END) AS BIGINT) AS any_docs FROM tok GROUP BY lang)
       SELECT lang, marker, docs, any_docs, CAST(sum(CASE WHEN list_contains(t, marker) THEN 1 ELSE 0 END) AS BIGINT) AS marker_docs, round(100.0 * sum(CASE WHEN list_contains(t, marker) THEN 1 ELSE 0 END) / docs, 3) AS percent FROM m JOIN d USING (lang) GROUP BY lang, marker, docs, any_docs""")
def marker_prevalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    tok = _tok(spark, sf_dir)
    marks = F.array(*[F.lit(m) for m in MARKERS])
    d = tok.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.arrays_overlap("tokens", marks).cast("long")).alias("any_docs"), *[F.sum(F.array_contains("tokens", m).cast("long")).alias(f"m{i}") for i, m in enumerate(MARKERS)])
    long = d.select("lang", "docs", "any_docs", F.explode(F.array(*[F.struct(F.lit(m).alias("marker"), F.col(f"m{i}").alias("n")) for i, m in enumerate(MARKERS)])).alias("s"))
    return long.select("lang", F.col("s.marker").alias("marker"), "docs", "any_docs", F.col("s.n").alias("marker_docs"), F.round(F.lit(100.0) * F.col("s.n") / F.col("docs"), 3).alias("percent"))


@query(f"""WITH {oracle.FREQ}, e AS (SELECT lang, token, {_sql_rules()} = regexp_replace(token, '(ing|ed|s)$', '') AS correct FROM freq)
       SELECT coalesce(lang, 'all') AS lang, count(*) AS items, CAST(sum(CAST(correct AS INT)) AS BIGINT) AS correct, round(avg(CAST(correct AS DOUBLE)), 6) AS accuracy FROM e GROUP BY ROLLUP (lang)""")
def annotation_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted against expected stems, by language and in all."""
    e = inc.document_frequency(_tok(spark, sf_dir)).select("lang", (st.suffix_stem(F.col("token"), RULES) == F.regexp_replace("token", "(ing|ed|s)$", "")).alias("correct"))
    return e.rollup("lang").agg(F.count(F.lit(1)).alias("items"), F.sum(F.col("correct").cast("long")).alias("correct"), F.round(F.avg(F.col("correct").cast("double")), 6).alias("accuracy")).withColumn("lang", F.coalesce("lang", F.lit("all")))


_STEMMED = f"""st AS (SELECT DISTINCT lang, doc_id, {_sql_rules()} AS stem FROM occ), nn AS (SELECT lang, sum(CAST(doc_id % 3 = 0 AS INT)) AS na, sum(CAST(doc_id % 3 <> 0 AS INT)) AS nc FROM documents GROUP BY lang),
    v AS (SELECT lang, stem FROM (SELECT lang, stem, sum(CAST(doc_id % 3 = 0 AS INT)) AS a, sum(CAST(doc_id % 3 <> 0 AS INT)) AS c FROM st GROUP BY ALL) JOIN nn USING (lang) WHERE a > 0 AND a < na AND c > 0 AND c < nc)"""


@query(f"""WITH {oracle.FREQ}, {_STEMMED}, s AS (SELECT lang, df, token, {_sql_rules()} AS stem FROM freq WHERE NOT list_contains({_STOP_SQL}, token)), u AS (SELECT lang, df, token, stem FROM s QUALIFY row_number() OVER (PARTITION BY lang, stem ORDER BY df DESC, token) = 1)
       SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY df DESC, token) AS place, token, stem FROM u JOIN v USING (lang, stem) QUALIFY place <= 250""")
def controlled_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords without stopwords in rank order whose stem is new and among the supported stems: the first 250."""
    tok = _sets(spark, sf_dir)
    stems = inc.occurrences(tok).select("doc_id", "lang", st.suffix_stem(F.col("token"), RULES).alias("token")).distinct()
    stems = stems.groupBy("doc_id", "lang").agg(F.collect_list("token").alias("tokens"))  # a document's own
    vocabulary = inc.supported_tokens(stems, F.col("doc_id") % 3 == 0).select("lang", F.col("token").alias("stem"))
    left = inc.remove_stopwords(tok, STOP)
    k = inc.document_frequency(left).withColumn("stem", st.suffix_stem(F.col("token"), RULES))
    u = k.groupBy("lang", "stem").agg(F.min(F.struct((-F.col("df")).alias("down"), "token")).alias("m")).select("lang", "stem", "m.down", "m.token").join(vocabulary, ["lang", "stem"], "left_semi")
    return u.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("down", "token"))).where("place <= 250").select("lang", F.col("place").cast("long").alias("place"), "token", "stem")


@query(f"""WITH {oracle.TOK}, f AS (SELECT source, token, count(*) AS df FROM (SELECT source, unnest(list_distinct(t)) AS token FROM tok JOIN documents USING (doc_id)) GROUP BY ALL)
       SELECT token, CAST(sum(df) AS BIGINT) AS df FROM f GROUP BY token HAVING count(*) = (SELECT count(DISTINCT source) FROM documents) ORDER BY sum(df) DESC, token LIMIT 50""")
def shared_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms that every source has, the most frequent 50."""
    docs = table(spark, sf_dir, "documents")
    f = inc.document_frequency(inc.tokenised(docs, group_col="source")).select(F.col("lang").alias("source"), "token", "df")
    return controls.shared_terms(f, docs.agg(F.countDistinct("source").alias("n")), 50)


@query("""WITH w AS (SELECT doc_id, regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\\p{L}\\p{N}_]+') AS t FROM documents), u AS (SELECT doc_id, unnest(t) AS x, generate_subscripts(t, 1) AS i FROM w WHERE len(t) >= 3), g AS (SELECT doc_id, x || ' ' || lead(x) OVER v || ' ' || lead(x, 2) OVER v AS x FROM u WINDOW v AS (PARTITION BY doc_id ORDER BY i)),
       f AS (SELECT DISTINCT doc_id, x FROM g WHERE x IS NOT NULL UNION ALL SELECT doc_id, array_to_string(t, ' ') FROM w WHERE len(t) IN (1, 2)) SELECT doc_id, count(*) AS n, min(x) AS least, max(x) AS most FROM f GROUP BY doc_id""")
def shingle_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingles of each document by the table function, in SQL."""
    udtf.register(spark)
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return udtf.text_extent(spark.sql("SELECT d.doc_id, s.shingle FROM {docs} d, LATERAL word_shingles(d.text, 3) s", docs=docs), "doc_id", "shingle")
