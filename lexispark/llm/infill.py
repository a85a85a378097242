"""Fill-in-middle transformation by escaped marker injection, wholly in column expressions.

A delimiter and an escape sign, both control characters, are escaped where a text holds them; then one replacement by pattern appends
the delimiter to every unit (a run of letters A-Z, or any other character). The number of units is the number of delimiters, and the units up to
a rank, or from one, are what ``substring_index`` gives; delimiters out, escapes undone, and the parts are assembled with their
sentinels. The exact text is rebuilt from the output and its form alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# sentinels before prefix, suffix and middle (fixed values)
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
# shares in percent: texts that are transformed, and of these the ones that begin with the suffix (fixed values)
TRANSFORMED, SUFFIX_FIRST = 90, 20

_DELIMITER, _ESCAPE = "\x1f", "\x1e"
_UNIT = f"{_ESCAPE}[01]|[A-Za-z]+|[^A-Za-z]"


def injected(text: Column) -> Column:
    """The text, escaped, with the delimiter after each of its units."""
    escaped = F.replace(F.replace(text, F.lit(_ESCAPE), F.lit(_ESCAPE + "0")), F.lit(_DELIMITER), F.lit(_ESCAPE + "1"))
    return F.regexp_replace(escaped, _UNIT, "$0" + _DELIMITER)


def restored(part: Column) -> Column:
    """A run of units as it stood in the text."""
    plain = F.replace(part, F.lit(_DELIMITER))
    return F.replace(F.replace(plain, F.lit(_ESCAPE + "1"), F.lit(_DELIMITER)), F.lit(_ESCAPE + "0"), F.lit(_ESCAPE))


def unit_count(marked: Column) -> Column:
    return (F.octet_length(marked) - F.octet_length(F.replace(marked, F.lit(_DELIMITER)))).cast("long")


def first_units(marked: Column, count: Column) -> Column:
    """The first ``count`` units (0: none)."""
    return F.call_function("substring_index", marked, F.lit(_DELIMITER), count.cast("int"))


def units_after(marked: Column, count: Column, n: Column) -> Column:
    """What follows the first ``count`` of n units: the text ends with a delimiter, so n - count + 1 parts from the right."""
    return F.call_function("substring_index", marked, F.lit(_DELIMITER), (count - n - 1).cast("int"))


def assembled(form: Column, prefix: Column, middle: Column, suffix: Column, text: Column) -> Column:
    p, s, m = F.concat(F.lit(PREFIX), prefix), F.concat(F.lit(SUFFIX), suffix), F.concat(F.lit(MIDDLE), middle)
    return F.when(form == "psm", F.concat(p, s, m)).when(form == "spm", F.concat(s, p, m)).otherwise(text)


def rebuilt(form: Column, output: Column) -> Column:
    """The text from an output and its form: a transformed text has no sentinels of its own, so each stands once."""
    body = F.substring(output, len(PREFIX) + 1, 2**31 - 1)
    inner = F.when(form == "psm", F.lit(SUFFIX)).otherwise(F.lit(PREFIX))
    head = F.split_part(body, inner, F.lit(1))
    rest = F.split_part(body, inner, F.lit(2))
    tail, middle = F.split_part(rest, F.lit(MIDDLE), F.lit(1)), F.split_part(rest, F.lit(MIDDLE), F.lit(2))
    return F.when(form == "psm", F.concat(head, middle, tail)).when(form == "spm", F.concat(tail, middle, head)).otherwise(output)


def _dice(id_: Column, place: int) -> Column:
    digest = F.sha2(F.concat(F.lit("1:"), id_.cast("string")), 256)
    return F.conv(F.substring(digest, 8 * place - 7, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n (units), form (plain, psm or spm), prefix, middle, suffix (null if plain) and output.

    The cuts and the form hang on doc_id alone, so repeated rows are transformed alike. Null and empty texts, texts that hold a sentinel, and
    rows without a doc_id stay plain. Control characters in a text survive; very long texts are transformed whole. Empty table: no rows. Other
    columns are ignored.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    d = d.withColumn("marked", injected(F.col("text")))
    d = d.withColumn("n", unit_count(F.col("marked"))).withColumns({f"h{i}": _dice(F.col("doc_id"), i) for i in (1, 2, 3, 4)})
    a, b = F.pmod("h1", F.col("n") + 1), F.pmod("h2", F.col("n") + 1)
    own = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    plain = (F.col("n") == 0) | own | F.col("h3").isNull() | (F.col("h3") % 100 >= TRANSFORMED)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < SUFFIX_FIRST, "spm").otherwise("psm")
    d = d.select("doc_id", "text", "marked", "n", F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"), form.alias("form"))
    cut, lo, hi = F.col("form") != "plain", F.col("lo"), F.col("hi")
    head = F.when(cut, first_units(F.col("marked"), hi))
    d = d.select("doc_id", "text", "n", "form", "lo", "hi", head.alias("head"), F.when(cut, restored(units_after(F.col("marked"), hi, F.col("n")))).alias("suffix"))
    # the head has no delimiter at its end: hi units, hi - 1 delimiters
    middle = F.call_function("substring_index", F.col("head"), F.lit(_DELIMITER), (lo - hi).cast("int"))
    d = d.select("doc_id", "text", "n", "form", "suffix", restored(first_units(F.col("head"), lo)).alias("prefix"), restored(middle).alias("middle"))
    return d.select("doc_id", "n", "form", "prefix", "middle", "suffix", assembled(F.col("form"), F.col("prefix"), F.col("middle"), F.col("suffix"), F.col("text")).alias("output"))


def digests(filled: DataFrame) -> DataFrame:
    """The transformation as lengths and digests: doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256."""
    chars = lambda c: F.length(c).cast("long")
    return filled.select(
        "doc_id", "n", "form", chars("prefix").alias("prefix_chars"), chars("middle").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"), F.sha2(rebuilt(F.col("form"), F.col("output")), 256).alias("restored_sha256"),
    )
