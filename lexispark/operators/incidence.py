"""From tokens to the document x keyword incidence, kept as a long table and never made dense."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexispark.functions.text import sequence_sha256, tokens
from lexispark.operators.numbering import numbered
from lexispark.session import spread, written


def tokenised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_col: str = "lang", **options) -> DataFrame:
    """doc_id, lang, tokens. Null texts have none."""
    return spread(docs.select(id_col, text_col, group_col), id_col).select(F.col(id_col).alias("doc_id"), F.col(group_col).alias("lang"), tokens(F.coalesce(F.col(text_col), F.lit("")), **options).alias("tokens"))


def token_sets(docs: DataFrame, **columns) -> DataFrame:
    """Distinct tokens of each document (doc_id, lang, tokens), found once and written: for all that counts or looks up tokens more than once."""
    tok = tokenised(docs, **columns)
    return written(tok.select("doc_id", "lang", F.array_distinct("tokens").alias("tokens")), "tokens")


def document_summary(tok: DataFrame) -> DataFrame:
    """doc_id, lang, token_count, unique_token_count, token_sequence_sha256."""
    return tok.select("doc_id", "lang", F.size("tokens").cast("long").alias("token_count"), F.size(F.array_distinct("tokens")).cast("long").alias("unique_token_count"), sequence_sha256(F.col("tokens")).alias("token_sequence_sha256"))


def occurrences(tok: DataFrame) -> DataFrame:
    """One row for each document and distinct token: doc_id, lang, token."""
    return tok.select("doc_id", "lang", F.explode(F.array_distinct("tokens")).alias("token"))


def document_frequency(tok: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., token, df): distinct tokens of a document count once."""
    return occurrences(tok).groupBy(*(["lang"] if by is None else by), "token").agg(F.count(F.lit(1)).alias("df"))


def vocabulary(tok: DataFrame, minimum: int = 2, most: float = 0.5) -> DataFrame:
    """Tokens with minimum <= df <= most * documents, numbered in code point order: idx, token, df."""
    n = tok.agg(F.count(F.lit(1)).alias("n"))
    df = document_frequency(tok, [])
    kept = df.crossJoin(F.broadcast(n)).where((F.col("df") >= minimum) & (F.col("df") <= F.col("n") * most))  # n is one row
    return numbered(kept.select("token", "df"), "idx", F.substring("token", 1, 2), "token").select("idx", "token", "df")


def supported_tokens(tok: DataFrame, auxiliary: Column) -> DataFrame:
    """lang, token, df of the tokens that some but not all documents of either side hold; ``auxiliary``: a condition on the documents that divides them."""
    a = F.coalesce(auxiliary, F.lit(False)).cast("long")
    sided = tok.select("doc_id", "lang", "tokens", a.alias("a"))
    n = sided.groupBy(F.col("lang").alias("__l")).agg(F.sum("a").alias("na"), F.sum(1 - F.col("a")).alias("nc"))
    per = sided.select("lang", "a", F.explode(F.array_distinct("tokens")).alias("token")).groupBy("lang", "token").agg(F.sum("a").alias("xa"), F.sum(1 - F.col("a")).alias("xc"))
    inner = (F.col("xa") > 0) & (F.col("xa") < F.col("na")) & (F.col("xc") > 0) & (F.col("xc") < F.col("nc"))
    return per.join(F.broadcast(n), F.col("lang").eqNullSafe(F.col("__l"))).where(inner).select("lang", "token", (F.col("xa") + F.col("xc")).alias("df"))  # a row a language


def top_keywords(tok: DataFrame, k: int, support: Column | None = None, auxiliary: Column | None = None) -> DataFrame:
    """The k tokens of each language with the highest df, ties by code point: lang, rank (from 0), token, df.

    ``support``: a condition on df. ``auxiliary``: as in ``supported_tokens``, which are the only ones then.
    """
    df = document_frequency(tok) if auxiliary is None else supported_tokens(tok, auxiliary)
    if support is not None:
        df = df.where(support)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("df"), "token"))
    return df.withColumn("rank", rank).where(F.col("rank") <= k).select("lang", (F.col("rank") - 1).cast("long").alias("rank"), "token", "df")


def stem_contenders(words: DataFrame, k: int) -> DataFrame:
    """lang, token: words whose stems may be among a language's k with the highest df, with all words of these stems. ``words``: lang, token, df, stem.

    A stem is in as many documents as its most frequent word at least, and as all its words together at most. So only stems that may reach the k-th such bound from below need be
    counted in the documents; of stems of a single word, whose df is known, the first k.
    """
    stems = written(words.groupBy("lang", "stem").agg(F.max("df").alias("least"), F.sum("df").alias("most"), F.count(F.lit(1)).alias("n")), "stems")
    by = Window.partitionBy("lang").orderBy(F.desc("least"), "stem")
    first = stems.withColumn("place", F.row_number().over(by)).where(F.col("place") <= k)
    floor = first.groupBy(F.col("lang").alias("__l")).agg(F.min(F.when(F.col("place") == k, F.col("least"))).alias("floor"))
    one = stems.where("n = 1").withColumn("place", F.row_number().over(by)).where(F.col("place") <= k).select("lang", "stem")
    more = stems.where("n > 1").join(F.broadcast(floor), F.col("lang").eqNullSafe(F.col("__l"))).where(F.col("most") >= F.coalesce("floor", F.lit(0))).select("lang", "stem")  # a row a language
    wanted = one.unionByName(more).select(F.col("lang").alias("__l"), F.col("stem").alias("__s"))
    return words.join(wanted, F.col("lang").eqNullSafe(F.col("__l")) & (F.col("stem") == F.col("__s")), "left_semi").select("lang", "token")


#: words of a language that are looked up in each document's own array
FEW = 4096


def restricted(tok: DataFrame, words: DataFrame) -> DataFrame:
    """The documents with only those tokens that are among ``words`` (lang, token; distinct), written: doc_id, lang, tokens. ``tok``: distinct tokens."""
    lists = written(words.groupBy(F.col("lang").alias("__l")).agg(F.count(F.lit(1)).alias("n")), "sizes")
    if (lists.agg(F.max("n")).first()[0] or 0) <= FEW:
        few = words.groupBy(F.col("lang").alias("__l")).agg(F.collect_list("token").alias("__t"))
        met = tok.join(F.broadcast(few), F.col("lang").eqNullSafe(F.col("__l")), "left")  # a bounded row a language
        kept = F.coalesce(F.array_intersect("tokens", "__t"), F.array().cast("array<string>"))
        return written(met.select("doc_id", "lang", kept.alias("tokens")), "restricted")
    numbered_rows = written(tok.withColumn("__i", F.monotonically_increasing_id()), "rows")
    many = words.select(F.col("lang").alias("__l"), F.col("token").alias("__t"))
    flat = numbered_rows.select("__i", "lang", F.explode("tokens").alias("token"))
    met = flat.join(many, F.col("lang").eqNullSafe(F.col("__l")) & (F.col("token") == F.col("__t")), "left_semi").groupBy("__i").agg(F.collect_list("token").alias("__k"))
    return written(numbered_rows.join(met, "__i", "left").select("doc_id", "lang", F.coalesce("__k", F.array().cast("array<string>")).alias("tokens")), "restricted")


def incidence(tok: DataFrame, keywords: DataFrame) -> DataFrame:
    """lang, doc_id, rank: one row for each document and keyword that it holds."""
    few = keywords.select(F.col("lang").alias("__l"), F.col("token").alias("__t"), "rank")
    return occurrences(tok).join(F.broadcast(few), F.col("lang").eqNullSafe(F.col("__l")) & (F.col("token") == F.col("__t"))).select("lang", "doc_id", "rank")  # K rows a language


def keyword_lists(tok: DataFrame, keywords: DataFrame) -> DataFrame:
    """lang, doc_id, r: sorted distinct keywords of each document that holds any, found where its tokens lie; only these short lists are grouped. Rows without doc_id take no part.

    ``keywords`` (lang, rank, token) is K rows a language, K bounded by configuration.
    """
    rows = keywords.groupBy("lang").agg(F.collect_list("token").alias("t"), F.collect_list("rank").alias("r")).collect()
    given = {row["lang"]: (pa.array(row["t"], pa.string()), np.array(row["r"], dtype=np.int64)) for row in rows}

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, listed = batch.column("lang"), batch.column("tokens")
            for own in pc.unique(lang):
                mine = pc.is_null(lang) if not own.is_valid else pc.fill_null(pc.equal(lang, own), False)
                if own.as_py() not in given:
                    continue
                words, ranks = given[own.as_py()]
                lists, ids = listed.filter(mine), batch.column("doc_id").filter(mine)
                at, doc = pc.index_in(lists.flatten(), words), pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
                hit = pc.is_valid(at).to_numpy(zero_copy_only=False)
                rank, doc = ranks[at.filter(pc.is_valid(at)).to_numpy(zero_copy_only=False)], doc[hit]
                order = np.lexsort((rank, doc))
                held, begin = np.unique(doc[order], return_index=True)
                offsets = pa.array(np.r_[begin, len(doc)], pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([own.as_py()] * len(held), pa.string()), ids.take(pa.array(held)), pa.ListArray.from_arrays(offsets, pa.array(rank[order]))], ["lang", "doc_id", "r"])

    kind = tok.schema["doc_id"].dataType.simpleString()
    found = tok.where("doc_id is not null").select("lang", "doc_id", "tokens").mapInArrow(find, f"lang string, doc_id {kind}, r array<long>")
    lists = F.collect_list("r")
    return found.groupBy("lang", "doc_id").agg(lists.alias("l")).select("lang", "doc_id", F.when(F.size("l") == 1, F.col("l")[0]).otherwise(F.array_sort(F.array_distinct(F.flatten("l")))).alias("r"))


def export_documents(tok: DataFrame, keywords: DataFrame) -> DataFrame:
    """Sorted keyword numbers of each document; documents without any keep an empty list."""
    lists = incidence(tok, keywords).groupBy("doc_id").agg(F.sort_array(F.collect_list("rank")).alias("keywords"))
    return tok.select("doc_id", "lang").join(lists, "doc_id", "left").select("doc_id", "lang", F.coalesce("keywords", F.array().cast("array<long>")).alias("keywords"))


def remove_stopwords(tok: DataFrame, stopwords: dict[str, list[str]]) -> DataFrame:
    """Tokens without their language's stopwords, and how many went: doc_id, lang, tokens, removed."""

    def without(words: list[str]) -> Column:
        return F.filter("tokens", lambda x: ~x.isin(*words))

    kept = F.col("tokens")
    for lang, words in stopwords.items():
        kept = F.when(F.col("lang") == lang, without(words)).otherwise(kept)
    return tok.select("doc_id", "lang", kept.alias("tokens"), (F.size("tokens") - F.size(kept)).cast("long").alias("removed"))


def apply_stems(tok: DataFrame, stem) -> DataFrame:
    """Stem the distinct vocabulary, join back, keep the order: doc_id, lang, tokens, changed. An empty stem is an error."""
    words = tok.select("lang", F.explode("tokens").alias("token")).distinct()
    return apply_stem_table(tok, words.withColumn("stem", stem(F.col("token"))))


def apply_stem_table(tok: DataFrame, stems: DataFrame) -> DataFrame:
    """``apply_stems`` by a table (lang, token, stem) of the whole vocabulary."""
    flat = tok.select("doc_id", "lang", F.posexplode("tokens").alias("pos", "token"))
    stems = stems.select(F.col("lang").alias("__l"), F.col("token").alias("__t"), F.when(F.col("stem") == "", F.raise_error(F.lit("empty stem")).cast("string")).otherwise(F.col("stem")).alias("stem"))
    met = flat.join(stems, F.col("lang").eqNullSafe(F.col("__l")) & (F.col("token") == F.col("__t")))
    done = met.groupBy("doc_id", "lang").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "stem"))), lambda s: s["stem"]).alias("tokens"), F.sum((F.col("stem") != F.col("token")).cast("long")).alias("changed"))
    empty = tok.where(F.size("tokens") == 0).select("doc_id", "lang", "tokens", F.lit(0).cast("long").alias("changed"))
    return done.unionByName(empty)


def stem_in_place(tok: DataFrame, stemmers: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """Tokens stemmed where they lie, by the stems of an array that each language has; no token moves: doc_id, lang, tokens, changed, removed. An empty stem is an error."""
    stems = F.col("tokens")
    for lang, stem in stemmers.items():
        # a function of Python's would be given all rows, so those of other languages are null for it
        own = F.col("lang") == lang
        stems = F.when(own, stem(F.when(own, F.col("tokens")))).otherwise(stems)
    done = tok.withColumn("stems", stems)
    kept = F.when(F.array_contains("stems", ""), F.raise_error(F.lit("empty stem")).cast("array<string>")).otherwise(F.col("stems"))
    changed = F.size(F.filter(F.zip_with("tokens", "stems", lambda a, b: a != b), lambda x: x)).cast("long")
    return done.select("doc_id", "lang", kept.alias("tokens"), changed.alias("changed"), "removed")


def stem_groups(vocabulary: DataFrame, stem: Column) -> DataFrame:
    """By language: types, stems, stems that merge several types, and the types in these."""
    per = vocabulary.select("lang", "token", stem.alias("stem")).groupBy("lang", "stem").agg(F.count(F.lit(1)).alias("k"))
    return per.groupBy("lang").agg(F.sum("k").alias("types"), F.count(F.lit(1)).alias("stems"), F.sum((F.col("k") > 1).cast("long")).alias("merged_stems"), F.sum(F.when(F.col("k") > 1, F.col("k")).otherwise(0)).alias("merged_types"))
