"""Queries over records: normal forms, hashes, validation, gates, pages."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.functions import text as tx
from lexispark.functions import web
from lexispark.operators import digests, policy
from lexispark.operators import records as rec
from lexispark.registry import query, table
from lexispark.session import shared_dir, spread, temporary

_SPLIT = "CASE WHEN instr(text, chr(10)) > 0 THEN substr(text, 1, instr(text, chr(10)) - 1) ELSE text END AS title, CASE WHEN instr(text, chr(10)) > 0 THEN substr(text, instr(text, chr(10)) + 1) ELSE '' END AS body"
_URL = "'https://' || source || '.example.org/doc/' || doc_id"


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records: the first line is the title."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text"), "doc_id")
    at = F.locate("\n", F.col("text"))
    return d.select("doc_id", "source", "lang", F.when(at > 0, F.substring_index("text", "\n", 1)).otherwise(F.col("text")).alias("title"), F.when(at > 0, F.substring("text", at + 1, 2**31 - 1)).otherwise(F.lit("")).alias("body"), F.concat(F.lit("https://"), "source", F.lit(".example.org/doc/"), "doc_id").alias("url"))


@query("""WITH p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(nfc_normalize(text), '\\r\\n?', chr(10), 'g'), '\\n[ \\t\\n\\f\\x0B]*\\n'),
       lambda x: regexp_replace(regexp_replace(regexp_replace(x, '[\\t \\f\\x0B]+', ' ', 'g'), ' *\\n *', ' ', 'g'), '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS p FROM documents)
       SELECT doc_id, CAST(len(p) AS BIGINT) AS paragraphs, sha256(array_to_string(p, chr(10) || chr(10))) AS text_sha256 FROM p""")
def normalised_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").select("doc_id", tx.normalise_text(F.col("text")).alias("t"))
    return d.select("doc_id", F.when(F.col("t") == "", F.lit(0)).otherwise(F.size(F.split("t", "\n\n", -1))).cast("long").alias("paragraphs"), F.sha2("t", 256).alias("text_sha256"))


@query(f"""WITH r AS (SELECT doc_id, source, {_SPLIT}, {_URL} AS url FROM documents)
       SELECT doc_id, sha256(source || chr(10) || url) AS record_id, sha256(body) AS content_sha256, sha256(replace(lower(title), 'ß', 'ss') || chr(10) || replace(lower(body), 'ß', 'ss')) AS normalised_text_sha256,
       CAST(len(regexp_extract_all(body, '[\\p{{L}}\\p{{N}}_]+')) AS BIGINT) AS words FROM r""")
def record_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir)
    return r.select("doc_id", tx.record_id(F.col("source"), F.col("url")).alias("record_id"), F.sha2("body", 256).alias("content_sha256"), tx.text_sha256(F.col("title"), F.col("body")).alias("normalised_text_sha256"), tx.word_count(F.col("body")).alias("words"))


_K = "CAST(substr(source, 4) AS INT)"
_MANIFEST = f"""SELECT source AS source_id, source AS name, CASE WHEN {_K} % 10 = 9 THEN 'blog' WHEN {_K} % 2 = 0 THEN 'publisher' ELSE 'archive' END AS source_kind, 'https://' || source || CASE WHEN {_K} % 8 = 7 THEN '.other.org' ELSE '.example.org' END || '/' AS base_url,
    CASE WHEN {_K} % 11 = 10 THEN ARRAY(source || '.example.org', source || '.example.org') ELSE ARRAY(source || '.example.org') END AS allowed_hosts, CASE WHEN {_K} % 3 = 0 THEN ARRAY('en', 'fr') ELSE ARRAY('en', 'de', 'es') END AS languages,
    CASE WHEN {_K} % 6 = 5 THEN 'candidate' ELSE 'approved' END AS status, CASE WHEN {_K} % 7 = 6 THEN 'permission_required' ELSE 'approved' END AS permission_status, CASE WHEN {_K} % 13 = 12 THEN 'derived_only' ELSE 'full_text' END AS storage_mode,
    'metadata_only' AS redistribution_mode, '' AS robots_url, '' AS terms_url, STRUCT({_K} <> 4) AS robots_review, CASE WHEN {_K} = 8 THEN NULL ELSE STRUCT(CASE WHEN {_K} = 14 THEN 'pending' ELSE 'approved' END) END AS project_authorisation,
    CASE WHEN {_K} = 3 THEN NULL ELSE 'letter' END AS permission_evidence, CASE WHEN {_K} = 16 THEN 'other_html_v9' ELSE 'fixture_html_v1' END AS parser_id, '' AS review_note, CASE WHEN {_K} = 18 THEN -1 ELSE 2 END AS minimum_request_interval_seconds
    FROM (SELECT DISTINCT source FROM {{documents}})"""


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest entry for each source, some of them faulty."""
    made = _MANIFEST.replace("ARRAY(", "array(").replace(f"STRUCT({_K} <> 4)", f"named_struct('collection_allowed', {_K} <> 4)").replace("STRUCT(CASE", "named_struct('status', CASE")
    return spark.sql(made.replace("{documents}", "{d}"), d=table(spark, sf_dir, "documents"))


_SOURCES = _MANIFEST.replace("ARRAY(", "list_value(").replace(f"STRUCT({_K} <> 4)", f"{{'collection_allowed': {_K} <> 4}}").replace(f"STRUCT(CASE WHEN {_K} = 14 THEN 'pending' ELSE 'approved' END)", f"{{'status': CASE WHEN {_K} = 14 THEN 'pending' ELSE 'approved' END}}").replace("{documents}", "documents")
_SOURCE_ERRORS = """CASE WHEN source_kind NOT IN ('publisher', 'archive', 'synthetic') THEN 'source_kind' END, CASE WHEN len(allowed_hosts) <> len(list_distinct(allowed_hosts)) THEN 'allowed_hosts' END, CASE WHEN NOT list_contains(allowed_hosts, regexp_extract(base_url, '//([^/]+)', 1)) THEN 'base_host' END,
    CASE WHEN minimum_request_interval_seconds < 0 THEN 'interval' END, CASE WHEN project_authorisation.status = 'pending' THEN 'authorisation_status' END, CASE WHEN status = 'approved' AND project_authorisation IS NULL THEN 'authorisation' END,
    CASE WHEN status = 'approved' AND permission_status <> 'approved' THEN 'permission' END, CASE WHEN status = 'approved' AND permission_evidence IS NULL THEN 'evidence' END, CASE WHEN status = 'approved' AND source_kind = 'publisher' AND NOT robots_review.collection_allowed THEN 'robots' END"""


@query(f"WITH s AS ({_SOURCES}) SELECT source_id, concat_ws(',', {_SOURCE_ERRORS}) AS errors FROM s")
def source_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(spark, sf_dir).select("source_id", F.array_join(policy.source_errors(), ",").alias("errors"))


@query(f"""WITH s AS (SELECT *, concat_ws(',', {_SOURCE_ERRORS}) AS wrong FROM ({_SOURCES})), r AS (SELECT lang, CASE WHEN doc_id % 17 = 0 THEN 'unlisted' ELSE source END AS source, CASE WHEN doc_id % 11 = 0 THEN 'other.org' ELSE source || '.example.org' END AS host FROM documents),
       g AS (SELECT CASE WHEN source_id IS NULL THEN 'unknown_source' WHEN wrong <> '' THEN 'invalid_source' WHEN status <> 'approved' THEN 'source_disabled' WHEN permission_status <> 'approved' THEN 'permission_missing' WHEN storage_mode <> 'full_text' THEN 'storage_forbidden' WHEN NOT list_contains(languages, lang) THEN 'language_not_listed'
       WHEN NOT list_contains(allowed_hosts, host) THEN 'host_not_allowed' WHEN parser_id <> 'fixture_html_v1' THEN 'parser_missing' ELSE 'accepted' END AS reason, source FROM r LEFT JOIN s ON source_id = source) SELECT source, reason, count(*) AS n FROM g GROUP BY ALL""")
def acquisition_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    host = F.when(F.col("doc_id") % 11 == 0, F.lit("other.org")).otherwise(F.concat("source", F.lit(".example.org")))
    r = docs.select(F.col("lang").alias("page_language"), F.when(F.col("doc_id") % 17 == 0, "unlisted").otherwise(F.col("source")).alias("source_id"), F.concat(F.lit("https://"), host, F.lit("/x")).alias("url"))
    g = r.join(F.broadcast(manifest(spark, sf_dir).withColumn("__known", F.lit(True))), "source_id", "left").select(F.col("source_id").alias("source"), F.coalesce(policy.gate("url", "page_language"), F.lit("accepted")).alias("reason"))  # a row a source
    return g.groupBy("source", "reason").agg(F.count(F.lit(1)).alias("n"))


_LANGS = ("en", "fr", "de", "es")
_STAMP = "strftime(make_timestamp(2024, 1, 1, 0, 0, 0) + to_hours(CAST(doc_id % 500 AS INT)), '%Y-%m-%dT%H:00:00')"


def raw_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as raw articles of approved sources: the first line is the title; times, addresses and lists in need of normalising."""
    r = records(spark, sf_dir).where("length(trim(title)) > 0 and length(trim(body)) > 0")
    at = F.date_format(F.timestamp_add("HOUR", (F.col("doc_id") % 500).cast("int"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:00:00")
    return r.select(
        F.col("source").alias("source_id"), F.col("lang").alias("language"), F.concat(F.lit("HTTPS://"), F.upper("source"), F.lit(".Example.org:443//doc/"), "doc_id", F.lit("/?utm_source=x&b=2&a=1#top")).alias("fetched_url"), "title", "body",
        F.when(F.col("doc_id") % 3 != 0, F.concat(at, F.lit("+00:00"))).alias("published_at"), F.concat(at, F.lit("Z")).alias("retrieved_at"), F.array(F.lit(" b "), F.lit("a"), F.lit("b"), F.lit("")).alias("authors"), "doc_id",
    )


def approved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sources, approved for all languages."""
    return table(spark, sf_dir, "documents").select(F.col("source").alias("source_id")).distinct().select(
        "source_id", F.lit("approved").alias("status"), F.lit("approved").alias("permission_status"), F.lit("full_text").alias("storage_mode"), F.lit("none").alias("redistribution_mode"), F.array(*map(F.lit, _LANGS)).alias("languages"))


_NORMAL = "array_to_string(list_filter(list_transform(regexp_split_to_array(regexp_replace(nfc_normalize({0}), '\\r\\n?', chr(10), 'g'), '\\n[ \\t\\n\\f\\x0B]*\\n'), lambda x: regexp_replace(regexp_replace(regexp_replace(x, '[\\t \\f\\x0B]+', ' ', 'g'), ' *\\n *', ' ', 'g'), '^\\s+|\\s+$', '', 'g')), lambda x: x <> ''), chr(10) || chr(10))"
_RECORDS = f"""r0 AS (SELECT doc_id, source, lang, {_SPLIT} FROM documents), r1 AS (SELECT doc_id, source, lang, {_NORMAL.format('title')} AS title, {_NORMAL.format('body')} AS body FROM r0 WHERE length(trim(title)) > 0 AND length(trim(body)) > 0),
    rec AS (SELECT *, sha256(source || chr(10) || canonical_url) AS record_id, sha256(body) AS content_sha256, sha256(replace(lower(title), 'ß', 'ss') || chr(10) || replace(lower(body), 'ß', 'ss')) AS normalised_text_sha256 FROM
       (SELECT *, 'https://' || source || '.example.org/doc/' || doc_id || '?a=1&b=2' AS canonical_url, CASE WHEN doc_id % 3 <> 0 THEN {_STAMP} || 'Z' END AS published_at, {_STAMP} || 'Z' AS retrieved_at FROM r1))"""


@query(f"""WITH {_RECORDS} SELECT record_id, source AS source_id, lang AS language, canonical_url, published_at, retrieved_at, sha256(title) AS title_sha256, content_sha256, normalised_text_sha256, 'a|b' AS authors, 'fixture-1.0.0' AS parser_version, 'approved' AS permission_status FROM rec""")
def normalised_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = rec.normalise_records(raw_articles(spark, sf_dir), approved(spark, sf_dir), _LANGS)
    return n.select("record_id", "source_id", "language", "canonical_url", "published_at", "retrieved_at", F.sha2("title", 256).alias("title_sha256"), "content_sha256", "normalised_text_sha256", F.array_join("authors", "|").alias("authors"), "processing.parser_version", "rights.permission_status")


@query(f"""WITH {_RECORDS} SELECT doc_id, concat_ws(',', CASE WHEN doc_id % 29 = 0 THEN 'schema_version' END, CASE WHEN doc_id % 31 = 0 THEN 'document_type' END, CASE WHEN lang NOT IN ('en', 'fr', 'de') THEN 'language' END, CASE WHEN doc_id % 19 = 0 THEN 'record_id' END, CASE WHEN doc_id % 23 = 0 THEN 'normalised_text_sha256' END,
       CASE WHEN doc_id % 13 = 0 THEN 'body_digest' END, CASE WHEN doc_id % 37 = 0 THEN 'title_nfc' END, CASE WHEN doc_id % 41 = 0 OR doc_id % 13 = 0 AND body <> nfc_normalize(body) THEN 'body_nfc' END, CASE WHEN doc_id % 7 = 0 THEN 'canonical_url' END, CASE WHEN doc_id % 17 = 0 THEN 'rights' END, CASE WHEN doc_id % 11 = 0 THEN 'duplicate' END, CASE WHEN doc_id % 11 <> 0 AND doc_id % 5 = 0 THEN 'duplicate_status' END, CASE WHEN doc_id % 11 <> 0 AND doc_id % 43 = 0 THEN 'duplicate_canonical' END) AS errors FROM rec""")
def record_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All checks of a record, each of them broken in some rows."""
    raw = raw_articles(spark, sf_dir)
    n = rec.normalise_records(raw, approved(spark, sf_dir), _LANGS).join(raw.select("doc_id", tx.record_id(F.col("source_id"), web.normalise_url(F.col("fetched_url"))).alias("record_id")), "record_id")
    every = lambda k: F.col("doc_id") % k == 0
    put = lambda name, k, value: F.when(every(k), value).otherwise(F.col(name)).alias(name)
    changed = {"schema_version": put("schema_version", 29, F.lit("0.9.0")), "document_type": put("document_type", 31, F.lit("note")), "record_id": put("record_id", 19, F.upper("record_id")), "normalised_text_sha256": put("normalised_text_sha256", 23, F.lit("")),
        "title": put("title", 37, F.concat("title", F.lit("e\u0301"))), "canonical_url": put("canonical_url", 7, F.concat("canonical_url", F.lit("#top")))}
    body = F.when(every(13), F.concat("body", F.lit("."))).otherwise(F.col("body"))
    body = F.when(every(41), F.concat(body, F.lit("e\u0301"))).otherwise(body)
    digest = F.when(every(41) & ~every(13), F.sha2(body, 256)).otherwise(F.col("content_sha256")).alias("content_sha256")
    rights = F.struct(F.when(every(17), "pending").otherwise("approved").alias("permission_status"), F.lit("full_text").alias("storage_mode"))
    dup = F.when(~every(11), F.struct(F.when(every(5), "other").otherwise("unique").alias("status"), F.when(every(43), "x").otherwise(F.sha2("body", 256)).alias("canonical_record_id")))
    keep = [c for c in n.columns if c not in {*changed, "body", "content_sha256", "rights"}]
    broken = n.select(*keep, *changed.values(), body.alias("body"), digest, rights.alias("rights"), dup.alias("duplicate"))
    return broken.select("doc_id", F.array_join(policy.record_errors(broken, ("en", "fr", "de"), require_duplicate=True), ",").alias("errors"))


@query("SELECT sha256(text) AS key, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def repeated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.repeated_keys(table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("key")), "key")


@query("""SELECT lang, count(*) AS docs, CAST(sum(CAST(contains(text, chr(65533)) AS INT)) AS BIGINT) AS replacement, CAST(sum(CAST(regexp_matches(text, '\\p{Cc}') AS INT)) AS BIGINT) AS control,
       CAST(sum(CAST(contains(text, '%') AS INT)) AS BIGINT) AS percent_signs, CAST(min(length(text)) AS BIGINT) AS shortest, round(quantile_cont(length(text), 0.25), 6) AS q25, round(quantile_cont(length(text), 0.5), 6) AS q50, round(avg(length(text)), 6) AS mean, round(quantile_cont(length(text), 0.95), 6) AS q95, CAST(max(length(text)) AS BIGINT) AS longest
       FROM documents GROUP BY lang""")
def character_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, n = table(spark, sf_dir, "documents"), F.length("text")
    one = lambda c, name: F.sum(c.cast("long")).alias(name)
    q = lambda p, name: F.round(F.percentile(n, F.lit(p)), 6).alias(name)
    return d.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), one(F.contains("text", F.lit("�")), "replacement"), one(F.col("text").rlike("\\p{Cc}"), "control"), one(F.contains("text", F.lit("%")), "percent_signs"), F.min(n).cast("long").alias("shortest"), q(0.25, "q25"), q(0.5, "q50"), F.round(F.avg(n), 6).alias("mean"), q(0.95, "q95"), F.max(n).cast("long").alias("longest"))


_DECODED = "replace(replace(replace(replace(replace(replace({0}, '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"
#: what a block left open at the article's end takes in goes on to the next end of a block
_BODY = "array_to_string(list_transform(string_split(a, '</p>'), lambda x: CASE WHEN contains(x, '<p>') AND (NOT contains(x, '</article>') OR instr(x, '<p>') < instr(x, '</article>')) THEN regexp_extract(x, '<p>(.*)$', 1, 's') ELSE '' END), '<x>')"
_CHUNKS = "list_filter(list_transform(regexp_split_to_array({0}, '<[^>]*>'), lambda x: trim(" + _DECODED.format("x") + ", ' ' || chr(9) || chr(10) || chr(13))), lambda x: x <> '')"


@query(f"""WITH a AS (SELECT page_id, html, regexp_extract(html, '<article>(.*?</article>.*?)(</p>|$)', 1, 's') AS a FROM pages), p AS (SELECT page_id, html, {_CHUNKS.format("regexp_extract(a, '<h1>(.*?)</h1>', 1, 's')")} AS t, {_CHUNKS.format(_BODY)} AS b FROM a)
       SELECT page_id, sha256(html) AS raw_sha256, array_to_string(t, ' ') AS title, sha256(array_to_string(b, chr(10) || chr(10))) AS body_sha256, CAST(len(b) AS INTEGER) AS paragraphs, CASE WHEN page_id % 9 = 0 THEN 'unknown_source' END AS reason FROM p WHERE page_id % 9 <> 0
       UNION ALL SELECT page_id, sha256(html), NULL, NULL, NULL, 'unknown_source' FROM pages WHERE page_id % 9 = 0""")
def parsed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored pages of one source (every ninth is of none): refused, or parsed with where they are from."""
    pages = spread(table(spark, sf_dir, "pages").select("page_id", "url", "html"), "page_id")
    p = pages.select(F.when(F.col("page_id") % 9 == 0, "nobody").otherwise("pages").alias("source_id"), "url", F.lit("en").alias("language"), "html", F.col("page_id").cast("string").alias("raw_reference"))
    hosts = F.collect_set(F.lower(F.parse_url("url", F.lit("HOST"))))  # a manifest lists its hosts
    m = p.where("source_id = 'pages'").agg(hosts.alias("allowed_hosts")).select(
        F.lit("pages").alias("source_id"), F.lit("archive").alias("source_kind"), F.lit("approved").alias("status"), F.lit("approved").alias("permission_status"), F.lit("full_text").alias("storage_mode"), F.lit("none").alias("redistribution_mode"), "allowed_hosts",
        F.concat(F.lit("https://"), F.col("allowed_hosts")[0]).alias("base_url"), F.lit(1).alias("minimum_request_interval_seconds"), F.named_struct(F.lit("status"), F.lit("approved")).alias("project_authorisation"), F.lit("letter").alias("permission_evidence"),
        F.lit("fixture_html_v1").alias("parser_id"), F.named_struct(F.lit("collection_allowed"), F.lit(True)).alias("robots_review"), F.array(F.lit("en")).alias("languages"))
    r = rec.parse_snapshots(p, m, "2024-01-01T00:00:00Z")
    return r.select(F.col("raw_reference").cast("long").alias("page_id"), "raw_sha256", "title", F.sha2("body", 256).alias("body_sha256"), F.size(F.split("body", "\n\n")).alias("paragraphs"), "reason")


_ENC = "replace(url_encode({0}), '%20', '+')"


@query(f"""WITH u AS (SELECT page_id, regexp_replace(url, '#.*$', '') AS u FROM pages), p AS (SELECT page_id, lower(regexp_extract(u, '^[a-z]+', 0)) AS s, lower(regexp_extract(u, '://([^/?]*)', 1)) AS h, rtrim(regexp_replace(regexp_extract(u, '://[^/?]*([^?]*)', 1), '/+', '/', 'g'), '/') AS p, regexp_extract(u, '\\?(.*)$', 1) AS q FROM u),
       k AS (SELECT *, list_sort(list_filter(list_transform(list_filter(string_split(q, '&'), lambda x: x <> ''), lambda x: {{'k': url_decode(replace(split_part(x, '=', 1), '+', ' ')), 'v': url_decode(replace(CASE WHEN contains(x, '=') THEN substr(x, instr(x, '=') + 1) ELSE '' END, '+', ' '))}}),
         lambda x: NOT starts_with(lower(x.k), 'utm_') AND lower(x.k) NOT IN ('fbclid', 'gclid', 'mc_cid', 'mc_eid', 'ref', 'source'))) AS a FROM p)
       SELECT page_id, s || '://' || regexp_replace(h, CASE s WHEN 'http' THEN ':80$' ELSE ':443$' END, '') || CASE WHEN p = '' THEN '/' ELSE p END || CASE WHEN len(a) = 0 THEN '' ELSE '?' || array_to_string(list_transform(a, lambda x: {_ENC.format('x.k')} || '=' || {_ENC.format('x.v')}), '&') END AS canonical_url FROM k""")
def canonical_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", web.normalise_url(F.col("url")).alias("canonical_url"))


@query("""WITH n AS (SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS base, unnest(regexp_extract_all(regexp_extract(html, '<nav>(.*?)</nav>', 1, 's'), 'href="(/[^"]*)"', 1)) AS href FROM pages), a AS (SELECT DISTINCT page_id, lower(base) || rtrim('/post' || regexp_replace(href, '[?#].*$', ''), '/') AS link, href FROM n)
       SELECT link, count(DISTINCT page_id) AS pages FROM a WHERE '/post' || regexp_replace(href, '[?#].*$', '') LIKE '/post/%' GROUP BY link""")
def listing_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's list of links, made a listing of posts."""
    listed = F.replace(F.replace("html", F.lit("<nav>"), F.lit(f'<nav class="wide {web.LISTING_CLASS}">')), F.lit('href="/'), F.lit('href="/post/'))
    p = table(spark, sf_dir, "pages").select(web.page_links(listed, F.col("url")).alias("links"))
    return p.select(F.explode("links").alias("link")).groupBy("link").agg(F.count(F.lit(1)).alias("pages"))


@query("SELECT lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)) AS host, count(*) AS pages, min(page_id) AS first_page FROM pages GROUP BY ALL")
def pages_by_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", F.lower(F.regexp_extract("url", "^https?://([^/:?#]+)", 1)).alias("host"))
    return p.groupBy("host").agg(F.count(F.lit(1)).alias("pages"), F.min("page_id").alias("first_page"))


@query("""WITH d AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL), b AS (SELECT 'no_english' AS code, source AS path, 'source has few English documents' AS message FROM d GROUP BY source HAVING sum(CASE WHEN lang = 'en' THEN n ELSE 0 END) < 0.6 * sum(n)
       UNION ALL SELECT 'few_documents', source, 'language has few documents' FROM d WHERE n < 5) SELECT DISTINCT code, path, message FROM b""")
def readiness_blockers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    en = d.groupBy("source").agg(F.sum(F.when(F.col("lang") == "en", F.col("n")).otherwise(0)).alias("e"), F.sum("n").alias("n")).where("e < 0.6 * n").select(F.lit("no_english").alias("code"), F.col("source").alias("path"), F.lit("source has few English documents").alias("message"))
    return policy.blockers(en, d.where("n < 5").select(F.lit("few_documents").alias("code"), F.col("source").alias("path"), F.lit("language has few documents").alias("message")))


@query("""WITH a AS (SELECT source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS c FROM documents GROUP BY source), b AS (SELECT source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS c FROM documents WHERE NOT (doc_id % 97 = 0 AND source < 'src2') GROUP BY source)
       SELECT *, 'left' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'right' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def rebuild_and_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored result and its rebuilding in another way, from a table that has lost some rows: only the sources concerned differ."""
    d = table(spark, sf_dir, "documents")
    stored = d.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("c"))
    left = d.where("not (doc_id % 97 = 0 and source < 'src2')")
    rebuilt = left.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("c")).groupBy("source").agg(F.sum("n").alias("n"), F.sum("c").alias("c"))
    return policy.differences(stored, rebuilt)


_LEAF = "sha256(n || ':' || a || ':' || b)"


@query(f"""WITH r AS (SELECT sha256('{{"doc_id":' || doc_id || '}}') AS k, sha256('{{"doc_id":' || doc_id || ',"lang":"' || lang || '","n_chars":' || n_chars || ',"source":"' || source || '"}}') AS h FROM documents),
    l AS (SELECT substr(k, 1, 2) AS node, count(*) AS n, CAST(sum(CAST('0x' || substr(h, 1, 15) AS BIGINT)) AS VARCHAR) AS a, CAST(sum(CAST('0x' || substr(h, 16, 15) AS BIGINT)) AS VARCHAR) AS b FROM r GROUP BY ALL),
    t2 AS (SELECT 2 AS level, node, n, {_LEAF} AS digest FROM l),
    t1 AS (SELECT 1 AS level, substr(node, 1, 1) AS node, CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(node || ':' || digest, ',' ORDER BY node)) AS digest FROM t2 GROUP BY substr(node, 1, 1)),
    t0 AS (SELECT 0 AS level, '' AS node, CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(node || ':' || digest, ',' ORDER BY node)) AS digest FROM t1 HAVING count(*) > 0)
    SELECT * FROM t2 UNION ALL SELECT * FROM t1 UNION ALL SELECT * FROM t0""")
def digest_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree of digests of the documents' facts: 256 ranges of doc_id's digest, sixteen nodes, one root."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars", "source")
    return digests.digest_tree(d, ["doc_id"], 2)


@query("""WITH a AS (SELECT doc_id, source, lang, n_chars FROM documents), b AS (SELECT doc_id, source, lang, CASE WHEN doc_id % 401 = 7 THEN n_chars + 1 ELSE n_chars END AS n_chars FROM documents WHERE doc_id % 509 <> 11)
       SELECT *, 'left' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'right' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""")
def tree_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' facts, kept with their tree, and a rebuilt table in which some rows are changed and some lost: only ranges with such rows are read."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    changed = F.when(F.col("doc_id") % 401 == 7, F.col("n_chars") + 1).otherwise(F.col("n_chars")).cast(d.schema["n_chars"].dataType)
    rebuilt = d.where("doc_id % 509 <> 11").withColumn("n_chars", changed)
    at = f"{shared_dir(spark)}/lexispark/trees-{uuid.uuid4().hex}"
    for name, rows in (("stored", d), ("rebuilt", rebuilt)):
        digests.write_with_tree(rows, f"{at}/{name}", ["doc_id"])
    temporary(spark, at)
    return digests.tree_differences(spark, f"{at}/stored", f"{at}/rebuilt", d.schema)[0]
