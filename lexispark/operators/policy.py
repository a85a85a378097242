"""Validation of sources and records as error arrays, and the gate that names the first reason against a source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispark.functions.text import nfc, tokens

# what fields of a source may hold (fixed values)
STATUS = ("approved", "candidate", "excluded")
PERMISSION = ("approved", "permission_required", "excluded")
STORAGE = ("full_text", "derived_only", "none")
KIND = ("publisher", "archive", "synthetic")
REDISTRIBUTION = ("full_text", "metadata_only", "none")
SOURCE_FIELDS = (
    "source_id", "name", "source_kind", "base_url", "allowed_hosts", "languages", "status", "permission_status", "storage_mode", "redistribution_mode", "robots_url", "terms_url",
    "robots_review", "project_authorisation", "permission_evidence", "parser_id", "review_note", "minimum_request_interval_seconds",
)
RECORD_FIELDS = (
    "schema_version", "record_id", "source_id", "document_type", "language", "canonical_url", "retrieved_at", "title", "body", "content_sha256", "normalised_text_sha256", "provenance", "rights", "processing",
)
DUPLICATE_STATUS = ("unique", "exact", "near")
_HEX = "^[a-f0-9]{64}$"


def missing_fields(df: DataFrame, fields: tuple[str, ...]) -> list[str]:
    """Fields that a table lacks, sorted."""
    return sorted(set(fields) - set(df.columns))


def errors(checks: list[tuple[str, Column]]) -> Column:
    """Names of the checks that fail, in order; a check that is null fails."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks]))


def _some(text: Column) -> Column:
    return F.length(F.coalesce(text, F.lit(""))) > 0


def source_errors() -> Column:
    """Checks of a manifest entry with all ``SOURCE_FIELDS`` (robots_review: struct with collection_allowed, project_authorisation: struct with status)."""
    approved = F.col("status") == "approved"
    unless = lambda ok: ~approved | F.coalesce(ok, F.lit(False))
    host = F.lower(F.parse_url("base_url", F.lit("HOST")))
    authorised = F.col("project_authorisation")
    return errors([
        ("source_kind", F.col("source_kind").isin(*KIND)), ("status", F.col("status").isin(*STATUS)), ("permission_status", F.col("permission_status").isin(*PERMISSION)), ("storage_mode", F.col("storage_mode").isin(*STORAGE)),
        ("redistribution_mode", F.col("redistribution_mode").isin(*REDISTRIBUTION)), ("allowed_hosts", (F.size("allowed_hosts") > 0) & (F.size(F.array_distinct("allowed_hosts")) == F.size("allowed_hosts"))),
        ("base_host", F.array_contains("allowed_hosts", host)), ("interval", F.col("minimum_request_interval_seconds") >= 0), ("authorisation_status", authorised.isNull() | F.coalesce(authorised["status"] == "approved", F.lit(False))),
        ("authorisation", unless(authorised.isNotNull())), ("permission", unless(F.col("permission_status") == "approved")), ("storage", unless(F.col("storage_mode") != "none")),
        ("evidence", unless(_some(F.col("permission_evidence")))), ("parser", unless(_some(F.col("parser_id")))),
        ("robots", ~approved | F.coalesce(F.col("source_kind") != "publisher", F.lit(True)) | F.coalesce(F.col("robots_review")["collection_allowed"], F.lit(False))),
    ])


def gate(url: str, language: str, parsers: tuple[str, ...] | None = None) -> Column:
    """The first reason against taking a page from its source, or null. Columns: those of ``source_errors`` and __known (null without a manifest entry)."""
    from lexispark.functions.web import PARSERS

    host = F.lower(F.parse_url(F.col(url), F.lit("HOST")))
    return (
        F.when(F.col("__known").isNull(), "unknown_source").when(F.size(source_errors()) > 0, "invalid_source").when(F.col("status") != "approved", "source_disabled")
        .when(F.col("permission_status") != "approved", "permission_missing").when(F.col("storage_mode") != "full_text", "storage_forbidden")
        .when(~F.coalesce(F.array_contains("languages", F.col(language)), F.lit(False)), "language_not_listed").when(~F.coalesce(F.array_contains("allowed_hosts", host), F.lit(False)), "host_not_allowed")
        .when(~F.coalesce(F.col("parser_id").isin(*(PARSERS if parsers is None else parsers)), F.lit(False)), "parser_missing")
    )


def record_errors(df: DataFrame, languages: tuple[str, ...] = ("en", "lus"), require_duplicate: bool = False) -> Column:
    """Checks of a normalised record: version, kind, language, digests and that of the body, normal forms, address, rights, duplicate annotation."""
    if lacking := missing_fields(df, RECORD_FIELDS):
        return F.array(*[F.lit(f"missing:{f}") for f in lacking])
    hexed = [(f, F.col(f).rlike(_HEX)) for f in ("record_id", "content_sha256", "normalised_text_sha256")]
    address = F.col("canonical_url").rlike("^https?://[^/?#]+") & ~F.contains("canonical_url", F.lit("#"))
    checks = [
        ("schema_version", F.col("schema_version") == "1.0.0"), ("document_type", F.col("document_type").isin("article", "parallel_text_block")), ("language", F.col("language").isin(*languages)), *hexed,
        ("body_digest", F.col("content_sha256") == F.sha2(F.coalesce("body", F.lit("")), 256)), ("title_nfc", nfc(F.coalesce("title", F.lit(""))) == F.coalesce("title", F.lit(""))), ("body_nfc", nfc(F.coalesce("body", F.lit(""))) == F.coalesce("body", F.lit(""))),
        ("canonical_url", address), ("rights", (F.col("rights")["permission_status"] == "approved") & (F.col("rights")["storage_mode"] == "full_text")),
    ]
    if "duplicate" in df.columns:
        d = F.col("duplicate")
        checks += [("duplicate", d.isNotNull() | F.lit(not require_duplicate)), ("duplicate_status", d.isNull() | d["status"].isin(*DUPLICATE_STATUS)), ("duplicate_canonical", d.isNull() | F.coalesce(d["canonical_record_id"].rlike(_HEX), F.lit(False)))]
    elif require_duplicate:
        checks.append(("duplicate", F.lit(False)))
    return errors(checks)


def repeated_keys(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def blockers(*frames: DataFrame) -> DataFrame:
    """Union of (code, message, path), sorted; a release is ready if it is empty."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.distinct().orderBy("code", "path", "message")


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that only one of two results has: empty if the rebuilt one equals the stored one."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def set_errors(expected: DataFrame, given: DataFrame, keys: list[str], valid: Column) -> DataFrame:
    """What is wrong with a returned set, one row a key and reason: missing, unexpected, repeated, or a row that is not ``valid``."""
    per = given.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.max((~F.coalesce(valid, F.lit(False))).cast("int")).alias("__bad"))
    both = expected.select(*keys).distinct().withColumn("__e", F.lit(True)).join(per, keys, "full_outer")
    why = [("missing", F.col("__n").isNull()), ("unexpected", F.col("__e").isNull()), ("repeated", F.col("__n") > 1), ("invalid", F.col("__bad") == 1)]
    return both.select(*keys, F.explode(F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in why]))).alias("reason"))


def import_decisions(issued: DataFrame, returned: DataFrame, keys: list[str], decision: str, allowed: list[str], pending: str = "pending") -> DataFrame:
    """The issued keys with the decision that came back; one that is missing, repeated or not allowed leaves its key pending."""
    ok = F.coalesce(F.col(decision).isin(*allowed), F.lit(False))
    per = returned.groupBy(*keys).agg(F.when((F.count(F.lit(1)) == 1) & F.bool_and(ok), F.min(decision)).alias(decision))
    return issued.select(*keys).join(per, keys, "left").withColumn(decision, F.coalesce(decision, F.lit(pending)))


def export_errors(k: int, keywords: str = "keywords") -> Column:
    """Checks of an exported keyword list: sorted and distinct, every number in range."""
    return errors([("order", F.col(keywords) == F.array_sort(F.array_distinct(keywords))), ("range", F.forall(keywords, lambda x: (x >= 0) & (x < k)))])


def split_errors(documents: DataFrame, split: DataFrame, key: str, disjoint: bool = True) -> DataFrame:
    """What is wrong with an export's identifiers and split, one row a key and reason.

    A key that occurs twice among the documents, a split entry without a document, one named twice on a side, or (if the split must be ``disjoint``)
    on both. ``split``: key, side.
    """
    per = documents.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    sides = split.groupBy(key, "side").agg(F.count(F.lit(1)).alias("__k")).groupBy(key).agg(F.max("__k").alias("__most"), F.count(F.lit(1)).alias("__sides"))
    both = per.join(sides, key, "full_outer")
    why = [("repeated", F.col("__n") > 1), ("unknown", F.col("__n").isNull()), ("named_twice", F.col("__most") > 1), ("overlap", (F.col("__sides") > 1) & F.lit(disjoint))]
    return both.select(key, F.explode(F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in why]))).alias("reason"))


def stopword_errors(languages: list[str]) -> Column:
    """Checks of a stopword entry. Columns: language, token, decision, reviewed_by, n (entries of the same language and token)."""
    return errors([
        ("language", F.col("language").isin(*languages)), ("reviewer", F.length(F.trim("reviewed_by")) > 0), ("repeated", F.col("n") == 1),
        ("token", tokens(F.col("token")) == F.array("token")), ("pending", F.col("decision") != "pending"),
    ])
