"""Table functions: one text in, one row a token or shingle out. For SQL users; plans use the column functions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

_WORD = re.compile(r"\w+")


@udtf(returnType="pos int, shingle string")
class WordShingles:
    """Distinct word n-grams of a text in the order in which they first occur; a text of fewer words is one gram, one without words none."""

    def eval(self, text: str, n: int) -> Iterator[tuple[int, str]]:
        words = _WORD.findall((text or "").casefold())
        grams = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] if len(words) >= n else [" ".join(words)] if words else []
        for pos, gram in enumerate(dict.fromkeys(grams)):
            yield pos, gram


@udtf(returnType="pos int, token string")
class Tokens:
    """Runs of letters, marks and digits of the folded NFC form with as many letters as asked for; an apostrophe between letters belongs to its word."""

    def eval(self, text: str, minimum_letters: int) -> Iterator[tuple[int, str]]:
        folded = unicodedata.normalize("NFC", text or "").casefold().replace("’", "'")
        kind = [unicodedata.category(c) for c in folded]
        letter = [k[0] in "LM" for k in kind]
        inside = [a or k == "Nd" or c == "'" and 0 < i < len(folded) - 1 and letter[i - 1] and letter[i + 1] for i, (c, k, a) in enumerate(zip(folded, kind, letter, strict=True))]
        pos, start = 0, None
        for i, on in enumerate([*inside, False]):
            if on and start is None:
                start = i
            elif not on and start is not None:
                if sum(letter[start:i]) >= minimum_letters:
                    yield pos, folded[start:i]
                    pos += 1
                start = None


def register(spark: SparkSession) -> None:
    """Make ``word_shingles(text, n)`` and ``text_tokens(text, minimum_letters)`` known to SQL, for use in lateral joins."""
    spark.udtf.register("word_shingles", WordShingles)
    spark.udtf.register("text_tokens", Tokens)


def text_extent(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, n, least, most: how many rows each key has, and its first and last text. Null texts count, but are neither.

    Least and most of texts make Spark sort all rows of a task. What a table function makes of one row comes together, so rows are summed up batch by batch first, and only
    the sums, about one a key, are grouped.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                got = pa.Table.from_batches([batch]).group_by(key, use_threads=False).aggregate([(text, "min"), (text, "max"), ([], "count_all")])
                yield from got.select([key, "count_all", f"{text}_min", f"{text}_max"]).rename_columns([key, "n", "least", "most"]).to_batches()

    kind = rows.schema[key].dataType.simpleString()
    part = rows.select(key, text).mapInArrow(sums, f"{key} {kind}, n long, least string, most string")
    return part.groupBy(key).agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))
