"""A corpus pipeline over ``documents``: toxicity, exact and near duplicates, a mix of sources, token ids.

Each stage takes (spark, docs, sf_dir) and works on all rows the stage before has kept; ``run`` writes each result as
Parquet and reads it again. All stages but the last return the columns of ``documents``; further columns are carried along
(names that begin with two underscores are ours). Rows without a doc_id are scored, mixed, encoded and never dropped as copies;
where a doc_id stands for several rows, each row is judged by its own text. Null texts are empty, long ones whole; empty inputs
give empty outputs of the same columns.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.llm import bpe, exact_dedup, minhash, mixing, toxicity
from lexispark.llm.common import load, small_batches, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go; the model is fitted on labelled rows outside the held-out fold."""
    return toxicity.reject(docs, toxicity.train(docs, load(spark, sf_dir, "labels")))


def _ids_repeat(docs: DataFrame) -> bool:
    return bool(docs.groupBy("doc_id").count().where("doc_id is null or count > 1").head(1))


def _with_rows(docs: DataFrame) -> DataFrame:
    """The documents, written with a number for each row: for tables whose doc_id does not tell rows apart."""
    return written(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (but for the case of A-Z) one row with the largest doc_id stays; which of several such rows is open.

    Texts are told apart by their digests, so a document whose doc_id stands for another text too stays or goes by its own text.
    Rows without a doc_id stay.
    """
    judged = written(exact_dedup.exact_dedup(docs, keep="max"), "judged")
    gone = judged.where("doc_id is not null and not kept").select(F.col("doc_id").alias("__id"), "text_sha256").distinct()
    plain = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), ascii_uppercase, ascii_lowercase)
    hashed = docs.withColumn("__hash", F.sha2(plain, 256))
    rows = hashed.join(gone, (F.col("doc_id") == F.col("__id")) & (F.col("__hash") == F.col("text_sha256")), "left_anti")
    if judged.where("kept").groupBy("doc_id").count().where("count > 1").head(1):
        rows = rows.where("doc_id is not null").dropDuplicates(["doc_id", "__hash"]).unionByName(rows.where("doc_id is null"))
    return rows.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row with the smallest doc_id stays; rows without a doc_id take no part and stay."""
    if not _ids_repeat(docs):
        gone = minhash.near_dedup(docs).where("not kept").select("doc_id")
        return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    rows = _with_rows(docs)
    named = rows.where("doc_id is not null")
    judged = minhash.near_dedup(named, id_col="__row").select(F.col("doc_id").alias("__row"), F.col("component_id").alias("__group"))
    of = written(named.select("__row", "doc_id").join(judged, "__row"), "near-groups")
    first = of.groupBy("__group").agg(F.min(F.struct("doc_id", "__row")).alias("m")).select("m.__row")
    gone = of.select("__row").join(first, "__row", "left_anti")
    return rows.join(gone, "__row", "left_anti").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it: not at all, once, or up to three times."""
    own = _ids_repeat(docs)
    rows, key = (_with_rows(docs), "__row") if own else (docs, "doc_id")
    drawn = mixing.mix_sources(rows, id_col=key).where("copies > 0").select(F.col("doc_id").alias("__id"), F.col("copies").alias("__copies"))
    met = rows.join(drawn, F.col(key) == F.col("__id"))
    return met.withColumn("__k", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row's whole text, with digests of the ids and of the text they decode to."""
    small_batches(spark)
    return bpe.encode_decode(docs, with_ids=True)


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_exact_copies), ("near dedup", drop_near_copies), ("mixing", mix), ("encoding", encode)]

#: toxicity, the sampling and the token ids are beyond SQL; the tests hold run() against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
