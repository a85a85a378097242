"""Scalar text functions: tokens, normal forms, hashes, shingles. All are column expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# classes of the tokeniser: letters or marks, these or decimal digits (fixed values); plain letters first, for they are told at once
LETTER = "[a-z\\p{L}\\p{M}]"
WORDLIKE = "[a-z0-9\\p{L}\\p{M}\\p{Nd}]"
# marks that may stand within a word, as they come and as they are kept (fixed values)
APOSTROPHES, HYPHENS = "’", "‐‑"
WORD = "[\\p{L}\\p{N}_]+"


def token_pattern(minimum_letters: int, numbers: bool, hyphens: bool) -> str:
    """A run of word characters, with an apostrophe (or a hyphen) only between letters, that has so many letters.

    The letters are looked for from the token's first place; no later place of a token that lacks them has more. Runs are possessive, so
    that no word is scanned twice.
    """
    mark = "['-]" if hyphens else "'"
    enough = f"(?=\\p{{Nd}}*+{LETTER}(?:(?:\\p{{Nd}}*+|{mark}){LETTER}){{{minimum_letters - 1}}})"
    word = f"{enough}{WORDLIKE}++(?:(?<={LETTER}){mark}(?={LETTER}){WORDLIKE}++)*+"
    return word + f"|(?<!{WORDLIKE})\\p{{Nd}}{{{minimum_letters},}}+(?!{WORDLIKE})" if numbers else word


def _icu(name: str, method: str, text: Column, flag: bool) -> Column:
    """A static method of the Unicode library that Spark itself ships, called in the JVM; ``text`` is not null."""
    return F.call_function("reflect", F.lit(f"com.ibm.icu.{name}"), F.lit(method), text, F.lit(flag))


def nfc(text: Column) -> Column:
    """Unicode normal form C. Text without a code point from U+0300 on is in that form."""
    return F.when(text.rlike("[\\x{300}-\\x{10FFFF}]"), _icu("text.Normalizer", "compose", text, False)).otherwise(text)


def casefold(text: Column) -> Column:
    """Full Unicode case folding; plain lower case where only letters before U+0100 occur, but for the micro sign and sharp s."""
    return F.when(text.rlike("[\\x{B5}\\x{DF}\\x{100}-\\x{10FFFF}]"), _icu("lang.UCharacter", "foldCase", text, True)).otherwise(F.lower(text))


def folded(text: Column) -> Column:
    """``casefold`` of the NFC form, looking at each text once."""
    composed = _icu("text.Normalizer", "compose", text, False)
    fold = lambda x: _icu("lang.UCharacter", "foldCase", x, True)
    return F.when(text.rlike("[\\x{300}-\\x{10FFFF}]"), fold(composed)).when(text.rlike("[\\x{B5}\\x{DF}\\x{100}-\\x{2FF}]"), fold(text)).otherwise(F.lower(text))


def bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is mentioned."""
    return F.element_at(F.transform(F.array(value), use), 1)


def tokens(text: Column, minimum_letters: int = 2, numbers: bool = False, hyphens: bool = False, fold: bool = True) -> Column:
    """Tokens in order, as array<string>, of the folded NFC form. Text that is null gives null.

    A token has ``minimum_letters`` letters or marks at least; one without any is a number, kept with ``numbers`` if it has as many digits.
    """
    plain = F.replace(folded(text) if fold else nfc(text), F.lit(APOSTROPHES), F.lit("'"))
    if hyphens:
        for mark in HYPHENS:
            plain = F.replace(plain, F.lit(mark), F.lit("-"))
    return F.regexp_extract_all(plain, F.lit(token_pattern(minimum_letters, numbers, hyphens)), F.lit(0))


def sequence_sha256(t: Column) -> Column:
    return F.sha2(F.array_join(t, "\n"), 256)


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def normalise_text(text: Column) -> Column:
    """NFC; line ends to newlines, paragraphs kept apart by one empty line, every other white space one blank."""
    lines = F.regexp_replace(nfc(text), "\\r\\n?", "\n")
    parts = F.transform(F.split(lines, "\\n[ \\t\\n\\f\\x0B]*\\n", -1), lambda p: F.regexp_replace(F.regexp_replace(F.regexp_replace(p, "[\\t \\f\\x0B]+", " "), " *\\n *", " "), "^\\s+|\\s+$", ""))
    return F.array_join(F.filter(parts, lambda p: p != ""), "\n\n")


def normalise_sentence(text: Column) -> Column:
    """NFC on one line: every run of white space one blank, none at the ends."""
    return F.trim(F.regexp_replace(nfc(text), "(?U)\\s+", " "))


def record_id(source_id: Column, canonical_url: Column) -> Column:
    return F.sha2(F.concat_ws("\n", source_id, canonical_url), 256)


def text_sha256(title: Column, body: Column) -> Column:
    """Digest of the folded title and body: equal for records that differ in case only."""
    return F.sha2(F.concat(casefold(title), F.lit("\n"), casefold(body)), 256)


def words(title: Column, body: Column) -> Column:
    """The folded words of title and body, one blank between them."""
    return F.array_join(F.regexp_extract_all(casefold(F.concat_ws(" ", title, body)), F.lit(WORD), F.lit(0)), " ")


def _split(text: Column) -> Column:
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, " ", -1))


def _grams(found: Column, n: int) -> Column:
    def grams(t: Column) -> Column:
        some = F.transform(F.sequence(F.lit(1), F.size(t) - n + 1), lambda i: F.array_join(F.slice(t, i, n), " "))
        return F.when(F.size(t) == 0, F.array().cast("array<string>")).when(F.size(t) < n, F.array(F.array_join(t, " "))).otherwise(F.array_distinct(some))

    # as a free expression within the inner function the words would be found anew for every gram
    return bound(found, grams)


def word_shingles(title: Column, body: Column, n: int = 3) -> Column:
    """Distinct word n-grams of title and body; fewer than n words give one gram of all of them, none an empty array."""
    return _grams(F.regexp_extract_all(casefold(F.concat_ws(" ", title, body)), F.lit(WORD), F.lit(0)), n)


def shingles_of(text: Column, n: int = 3) -> Column:
    """``word_shingles`` of what ``words`` gives."""
    return _grams(_split(text), n)


def shingle_hashes(text: Column) -> Column:
    """One hash for each of the word triples that ``shingles_of`` gives, distinct: the same for equal shingles, found without writing them out."""

    def triples(h: Column) -> Column:
        n = F.size(h) - 2
        return F.array_distinct(F.zip_with(F.zip_with(F.slice(h, 1, n), F.slice(h, 2, n), lambda a, b: F.xxhash64(a, b)), F.slice(h, 3, n), lambda ab, c: F.xxhash64(ab, c)))

    def hashes(t: Column) -> Column:
        return F.when(F.size(t) == 0, F.array().cast("array<bigint>")).when(F.size(t) < 3, F.array(F.xxhash64(t))).otherwise(bound(F.transform(t, lambda w: F.xxhash64(w)), triples))

    return bound(_split(text), hashes)


def set_digest(hashes: Column) -> Column:
    """Digest of a set of hashes: 128 bits, and their number."""
    return bound(F.sort_array(hashes), lambda h: F.concat_ws(":", F.size(h), F.hex(F.xxhash64(h)), F.hex(F.xxhash64(F.lit(1), h))))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def stable_score(seed: int | str, *ids: Column) -> Column:
    """Digest of a seed and identifiers, one a line: a random order that every engine can compute."""
    return F.sha2(F.concat_ws("\n", F.lit(str(seed)), *[i.cast("string") for i in ids]), 256)


def local_seed(text: Column) -> Column:
    """First four bytes, little endian, of a digest: the seed of one task."""
    h = F.sha2(text, 256)
    return F.conv(F.concat(*[F.substring(h, 7 - 2 * i, 2) for i in range(4)]), 16, 10).cast("long")


def match_id(*ids: Column) -> Column:
    """Digest of the identifiers of a matched pair, one a line."""
    return F.sha2(F.concat_ws("\n", *ids), 256)


def parse_timestamp(text: Column, field: str = "timestamp", required: bool = False) -> Column:
    """ISO time with its offset, kept as text, +00:00 written Z. Empty gives null, or an error if ``required``; so does what is no
    time of the calendar, or has no offset."""
    clean = F.trim(text)
    form = clean.rlike("^\\d{4}-\\d{2}-\\d{2}[T ]\\d{2}:\\d{2}(:\\d{2}(\\.\\d{1,6})?)?(Z|[+-]([01]\\d|2[0-3]):[0-5]\\d)$")
    real = F.try_to_timestamp(F.regexp_replace(F.substring(clean, 1, 16), "T", " "), F.lit("yyyy-MM-dd HH:mm")).isNotNull() & ~clean.rlike("^.{16}:[6-9]")
    whole = F.regexp_replace(F.regexp_replace(clean, "^(.{10}) ", "$1T"), "^(.{16})(?=[Z+-])", "$1:00")
    # fractions are given in microseconds, or not at all if they are none
    parted = F.regexp_replace(F.regexp_replace(whole, "\\.0+(?=[Z+-])", ""), "(\\.\\d+)(?=[Z+-])", "$100000")
    out = F.regexp_replace(F.regexp_replace(parted, "(\\.\\d{6})\\d*", "$1"), "\\+00:00$", "Z")
    wrong = lambda why: F.raise_error(F.concat(F.lit(f"{field} {why}: "), F.coalesce(clean, F.lit("null")))).cast("string")
    none = wrong("is missing") if required else F.lit(None).cast("string")
    return F.when(clean.isNull() | (clean == ""), none).when(form & real, out).otherwise(wrong("is no time with an offset"))


def concordance_line(text: Column, most: int = 180) -> Column:
    line = F.trim(F.regexp_replace(text, "\\s+", " "))
    return F.when(F.length(line) <= most, line).otherwise(F.concat(F.rtrim(F.substring(line, 1, most - 1)), F.lit("…")))


def keyword_size(dataset: Column) -> Column:
    """The k of a dataset named ...:k<number>, else null."""
    return F.nullif(F.regexp_extract(dataset, ":k([0-9]+)$", 1), F.lit("")).cast("int")


def record_url(url: Column, language: Column, split: Column) -> Column:
    """An address that also names language and split."""
    more = F.concat(F.lit("language="), F.url_encode(language), F.lit("&split="), F.url_encode(split))
    return F.concat(url, F.when(F.contains(url, F.lit("?")), F.lit("&")).otherwise(F.lit("?")), more)


def scan_order(published_at: str = "published_at", retrieved_at: str = "retrieved_at") -> Column:
    """What records are scanned by: the time of publication, else of retrieval, compared as text."""
    return F.coalesce(F.nullif(F.col(published_at), F.lit("")), F.col(retrieved_at))


def json_digest(*columns: str) -> Column:
    """Digest of an object in compact JSON, its keys sorted and nulls kept."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"}), 256)
