"""Queries that write tables in the formats of the sources and read them back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.functions import text as tx
from lexispark.operators import incidence as inc
from lexispark.operators.numbering import number_range, numbered
from lexispark.plans import oracle
from lexispark.registry import query, table
from lexispark.session import shared_dir, temporary
from lexispark.sources import archive, files


def _folder(spark: SparkSession, tag: str) -> str:
    """A folder of its own in the shared one; it goes when the application ends."""
    path = f"{shared_dir(spark)}/lexispark/{tag}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(at)
    temporary(spark, path)
    return path


@query("SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE source END AS source, lang, [lang, source] AS tags, sha256(text) AS text_sha256 FROM documents")
def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as JSON lines, nulls and lists included, read under their schema."""
    d = table(spark, sf_dir, "documents")
    path = f"{_folder(spark, 'lines')}/documents"
    files.write_jsonl(d.select("doc_id", F.when(F.col("doc_id") % 7 != 0, F.col("source")).alias("source"), "lang", F.array("lang", "source").alias("tags"), "text"), path, "doc_id")
    back = files.read_jsonl(spark, path, "doc_id long, source string, lang string, tags array<string>, text string")
    return back.select("doc_id", "source", "lang", "tags", F.sha2("text", 256).alias("text_sha256"))


_SENTENCE = "trim(regexp_replace(nfc_normalize({0}), '\\s+', ' ', 'g'))"


@query(f"""WITH b AS (SELECT u.conv_id, u.turn, {_SENTENCE.format('u.text')} AS l, {_SENTENCE.format('a.text')} AS r FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1 AND u.role = 'user' AND a.role = 'assistant')
       SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS row, sha256(l) AS left_sha256, sha256(r) AS right_sha256 FROM b""")
def aligned_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions and answers as two files aligned line by line."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", tx.normalise_sentence(F.col("text")).alias("t"))
    u = c.where("role = 'user'").select("conv_id", "turn", F.col("t").alias("l"))
    a = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("t").alias("r"))
    both = numbered(u.join(a, ["conv_id", "turn"]), "row", number_range(F.col("conv_id")), "conv_id", "turn")
    path = _folder(spark, "aligned")
    for side in ("l", "r"):
        both.orderBy("row").select(F.col(side).alias("value")).write.text(f"{path}/{side}")
    return files.read_aligned(spark, f"{path}/l", f"{path}/r").select("row", F.sha2("left", 256).alias("left_sha256"), F.sha2("right", 256).alias("right_sha256"))


@query("SELECT url AS \"URL\", regexp_extract(url, '//([^/]*)', 1) AS domain, CAST(contains(html, '<img') AS VARCHAR) AS has_image, CAST(contains(html, 'href') AS VARCHAR) AS has_hyperlink FROM pages")
def metadata_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages' metadata as tab-separated rows under their header."""
    p = table(spark, sf_dir, "pages").select(F.col("url").alias("URL"), F.regexp_extract("url", "//([^/]*)", 1).alias("domain"), F.contains("html", F.lit("<img")).alias("has_image"), F.contains("html", F.lit("href")).alias("has_hyperlink"))
    path = f"{_folder(spark, 'table')}/metadata"
    p.write.option("sep", "\t").option("header", True).csv(path)
    return files.read_table(spark, path, ["URL", "domain", "has_image", "has_hyperlink"])


@query(f"""WITH {oracle.keywords(30)}, l AS (SELECT doc_id, list_sort(list(rank)) AS r FROM inc GROUP BY doc_id) SELECT lang, 'token' AS condition, 30 AS k, doc_id, coalesce(array_to_string(r, ','), '') AS keywords FROM documents LEFT JOIN l USING (doc_id)""")
def export_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword lists in folders by language, condition and k."""
    tok = inc.token_sets(table(spark, sf_dir, "documents"))
    out = inc.export_documents(tok, inc.top_keywords(tok, 30)).select("doc_id", "lang", F.lit("token").alias("condition"), F.lit(30).alias("k"), "keywords")
    path = f"{_folder(spark, 'export')}/lists"
    files.write_export(out, path)
    return spark.read.parquet(path).select("lang", "condition", "k", "doc_id", F.array_join("keywords", ",").alias("keywords"))


@query(f"""WITH {oracle.FREQ} SELECT 'documents' AS name, (SELECT count(*) FROM documents) AS rows, 'doc_id,lang,n' AS columns, true AS whole UNION ALL SELECT 'vocabulary', (SELECT count(*) FROM freq), 'df,lang,token', true UNION ALL SELECT 'incidence', (SELECT count(*) FROM occ), 'doc_id,lang,token', true""")
def artefact_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A matrix and its tables with their metadata, which are then held against what was written."""
    tok = inc.token_sets(table(spark, sf_dir, "documents"))
    path = _folder(spark, "artefacts")
    meta = files.write_artifacts(path, documents=tok.select("doc_id", "lang", F.size("tokens").alias("n")), vocabulary=inc.document_frequency(tok), incidence=inc.occurrences(tok))
    wrong = files.verify_artifacts(spark, path)
    return meta.select("name", "rows", "columns", (~F.col("name").isin(*wrong) if wrong else F.lit(True)).alias("whole"))


@query("SELECT doc_id, lang, octet_length(encode(text)) AS size, sha256(text) AS text_sha256, true AS whole FROM documents WHERE text IS NOT NULL")
def archive_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as entries of ZIP files, one folder a language, put in place with their manifest; then read by ranges, each checked by size and CRC-32."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    path = f"{_folder(spark, 'archive')}/documents"
    archive.write_archive(d.select(F.format_string("%s/%d.txt", "lang", "doc_id").alias("entry"), F.encode("text", "UTF-8").alias("content")), path)
    wrong = archive.verify_archive(path)
    back = archive.read_archive(spark, path, partition_bytes=1 << 20)
    name = F.split("entry", "[/.]")
    return back.select(name[1].cast("long").alias("doc_id"), name[0].alias("lang"), "size", F.sha2("content", 256).alias("text_sha256"), F.lit(not wrong).alias("whole"))


@query("SELECT source AS source_id, count(*) AS documents, list_sort(list(DISTINCT lang)) AS languages, min(doc_id) AS first FROM documents WHERE source IS NOT NULL GROUP BY source")
def manifest_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources as one manifest file, an entry each, read under its schema and held against repeated keys."""
    d = table(spark, sf_dir, "documents").where("source is not null").groupBy(F.col("source").alias("source_id")).agg(F.count(F.lit(1)).alias("documents"), F.sort_array(F.collect_set("lang")).alias("languages"), F.min("doc_id").alias("first"))
    path = f"{_folder(spark, 'manifest')}/sources"
    d.agg(F.collect_list(F.struct("source_id", "documents", "languages", "first")).alias("sources")).coalesce(1).write.json(path)  # an entry a source
    return files.read_manifest(spark, path, schema="source_id string, documents long, languages array<string>, first long")
