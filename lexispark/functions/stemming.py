"""Stemmers: suffix rules as generated column expressions, the repeated kinds and the English stemmer for vocabularies.

What hangs on a word alone stems tokens where they lie; stemmers that look words up are applied to the distinct vocabulary and joined back.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Rule:
    suffix: str
    replacement: str = ""
    minimum: int = 2
    priority: int = 0
    exceptions: tuple[str, ...] = ()


def ordered(rules: list[Rule]) -> list[Rule]:
    """By priority, then the longest suffix, then its letters."""
    return sorted(rules, key=lambda r: (r.priority, -len(r.suffix), r.suffix))


# the one algorithm that a specification of each language may name (fixed values)
ALGORITHMS = {"en": "snowball_english", "lus": "suffix_strip_v1"}


def validate_specification(spec: dict, language: str, scope: str) -> list[str]:
    """What is wrong with a stemmer's specification: language, scope, status, review, algorithm, and its rules."""
    checks = [
        ("language", spec.get("language") == language), ("scope", spec.get("scope") == scope), ("status", spec.get("status") == "approved"), ("review", bool(spec.get("reviewed_by") and spec.get("reviewed_at"))),
        ("algorithm", language not in ALGORITHMS or spec.get("algorithm") == ALGORITHMS[language]),
    ]
    return [name for name, ok in checks if not ok] + validate_rules(rules_of(spec))


def rules_of(spec: dict) -> list[Rule]:
    return [Rule(r["suffix"], r.get("replacement", ""), int(r["minimum_stem_letter_count"]), int(r["priority"]), tuple(r.get("exceptions", ()))) for r in spec.get("rules", [])]


def validate_rules(rules: list[Rule]) -> list[str]:
    """What is wrong with a rule list; empty if nothing is."""
    wrong = []
    seen: set[tuple[str, int]] = set()
    for r in rules:
        if (r.suffix, r.priority) in seen:
            wrong.append(f"suffix and priority repeat: {r.suffix} {r.priority}")
        seen.add((r.suffix, r.priority))
        if r.suffix != unicodedata.normalize("NFC", r.suffix).casefold() or not r.suffix:
            wrong.append(f"suffix is not folded NFC: {r.suffix!r}")
        if r.minimum < 1:
            wrong.append(f"minimum below 1: {r.suffix}")
    return wrong


def suffix_stem(token: Column, rules: list[Rule], original: Column | None = None) -> Column:
    """The first rule that fits, once: a chain of WHENs built from the rules. A word is excepted as it is and, if given, as it came."""
    letters = lambda x: F.length(F.regexp_replace(x, "[^\\p{L}\\p{M}]", ""))
    out = None
    for r in ordered(rules):
        rest = F.concat(F.substring(token, F.lit(1), F.length(token) - len(r.suffix)), F.lit(r.replacement))
        fits = token.endswith(r.suffix) & (letters(rest) >= r.minimum)
        if r.exceptions:
            fits &= ~token.isin(*r.exceptions)
            if original is not None:
                fits &= ~original.isin(*r.exceptions)
        out = F.when(fits, rest) if out is None else out.when(fits, rest)
    return token if out is None else out.otherwise(token)


def repeated_suffix_stem(token: Column, rules: list[Rule]) -> Column:
    """``suffix_stem`` until nothing changes; every rule shortens, so as many steps as the word is long reach that. Exceptions hold
    for the word as it came and as it is."""
    if any(not r.suffix or len(r.replacement) >= len(r.suffix) for r in rules):
        raise ValueError("every rule must shorten the word")
    # a fold, so that the chain of rules stands in the plan once
    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(token))), token, lambda now, _: suffix_stem(now, rules, token))


def _rests(rules: list[Rule], letters_only: bool):
    """Function (word, now): the rules that fit, in order, with what each leaves."""
    chain = ordered(rules)
    kinds = ("L",) if letters_only else ("L", "M")

    def rests(word: str, now: str):
        for r in chain:
            rest = now[: -len(r.suffix)] + r.replacement
            blocked = now in r.exceptions or (not letters_only and word in r.exceptions)
            if now.endswith(r.suffix) and not blocked and len(rest) < len(now) and sum(unicodedata.category(c)[0] in kinds for c in rest) >= r.minimum:
                yield r, rest

    return rests


def guarded_stemmer(rules: list[Rule], guarded: frozenset[str], lexicon: frozenset[str] | None = None, letters_only: bool = False):
    """pandas UDF: repeat until nothing changes; a rule with a guarded suffix needs its candidate in ``lexicon``; exceptions
    hold for the word as it came and as it is. ``letters_only``: marks do not count towards the minimum. Without ``lexicon``
    the UDF's second column lists which of the word's ``guarded_candidates`` are known."""
    rests = _rests(rules, letters_only)

    def one(word: str, known) -> str:
        now = unicodedata.normalize("NFC", word)
        while True:
            for r, rest in rests(word, now):
                if r.suffix not in guarded or rest in known:
                    now = rest
                    break
            else:
                return now

    if lexicon is None:

        @F.pandas_udf(T.StringType())
        def stem_known(words: pd.Series, known: pd.Series) -> pd.Series:
            return pd.Series([None if w is None else one(w, frozenset(() if k is None else k)) for w, k in zip(words, known, strict=True)], dtype=object)

        return stem_known

    @F.pandas_udf(T.StringType())
    def stem(words: pd.Series) -> pd.Series:
        return words.map(lambda w: None if w is None else one(w, lexicon))

    return stem


def guarded_candidates(rules: list[Rule], guarded: frozenset[str], letters_only: bool = False):
    """pandas UDF: every candidate of a guarded suffix that ``guarded_stemmer`` may look up for a word, whatever is known."""
    rests = _rests(rules, letters_only)

    def one(word: str) -> list[str]:
        out: set[str] = set()
        seen, todo = set(), [unicodedata.normalize("NFC", word)]
        while todo:
            now = todo.pop()
            if now in seen:
                continue
            seen.add(now)
            for r, rest in rests(word, now):
                todo.append(rest)
                if r.suffix not in guarded:
                    break
                out.add(rest)
        return sorted(out)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def candidates(words: pd.Series) -> pd.Series:
        return words.map(lambda w: [] if w is None else one(w))

    return candidates


_VOWELS = frozenset("aeiouy")
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
# words with stems of their own in the published English stemmer (fixed values)
_SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
_SAME = frozenset("sky news howe atlas cosmos bias andes".split())
_AFTER_1A = frozenset("inning outing canning herring earring proceed exceed succeed".split())
# suffixes of steps 2 to 4 of the same description (fixed values)
_STEP2 = [("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", "")]
_STEP3 = [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", "")]
_STEP4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic"]


def _regions(w: str) -> tuple[int, int]:
    def after(i: int) -> int:
        for k in range(i + 1, len(w)):
            if w[k] not in _VOWELS and w[k - 1] in _VOWELS:
                return k + 1
        return len(w)

    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = after(0) if r1 is None else r1
    return r1, after(r1) if r1 < len(w) else len(w)


def _short_end(w: str) -> bool:
    if len(w) == 2:
        return w[0] in _VOWELS and w[1] not in _VOWELS
    return len(w) > 2 and w[-1] not in _VOWELS and w[-1] not in "wxY" and w[-2] in _VOWELS and w[-3] not in _VOWELS


def english_stem(word: str) -> str:
    """Porter's second English stemmer, after its published description."""
    w = word.replace("’", "'")
    if len(w) <= 2:
        return w
    if w in _SPECIAL:
        return _SPECIAL[w]
    if w in _SAME:
        return w
    w = w.removeprefix("'")
    w = "".join("Y" if c == "y" and (i == 0 or w[i - 1] in _VOWELS) else c for i, c in enumerate(w))
    r1, r2 = _regions(w)
    for s in ("'s'", "'s", "'"):
        if w.endswith(s):
            w = w[: -len(s)]
            break
    # 1a
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and any(c in _VOWELS for c in w[:-2]):
        w = w[:-1]
    if w in _AFTER_1A:
        return w.lower()
    # 1b
    for s in ("eedly", "ingly", "edly", "eed", "ing", "ed"):
        if w.endswith(s):
            stem = w[: -len(s)]
            if s in ("eed", "eedly"):
                w = stem + "ee" if len(stem) >= r1 else w
            elif any(c in _VOWELS for c in stem):
                if stem.endswith(("at", "bl", "iz")):
                    w = stem + "e"
                elif stem.endswith(_DOUBLES):
                    w = stem[:-1]
                else:
                    w = stem + "e" if _short_end(stem) and r1 >= len(stem) else stem
            break
    # 1c
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _VOWELS:
        w = w[:-1] + "i"
    for s, to in _STEP2:
        if w.endswith(s):
            stem = w[: -len(s)]
            if len(stem) >= r1 and not (s == "ogi" and not stem.endswith("l")) and not (s == "li" and (not stem or stem[-1] not in "cdeghkmnrt")):
                w = stem + to
            break
    for s, to in _STEP3:
        if w.endswith(s):
            stem = w[: -len(s)]
            if len(stem) >= (r2 if s == "ative" else r1):
                w = stem + to
            break
    for s in _STEP4:
        if w.endswith(s):
            stem = w[: -len(s)]
            if len(stem) >= r2 and not (s == "ion" and not stem.endswith(("s", "t"))):
                w = stem
            break
    if w.endswith("e"):
        if len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _short_end(w[:-1]):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


@F.pandas_udf(T.StringType())
def english_stems(words: pd.Series) -> pd.Series:
    return words.map(lambda w: None if w is None else english_stem(w))


@lru_cache(1 << 17)
def _english_stem(word: str) -> str:
    return english_stem(word)


@F.arrow_udf(T.ArrayType(T.StringType()))
def english_stem_arrays(tokens: pa.Array) -> pa.Array:
    """Stems of the tokens of each array; a batch's distinct words are stemmed once. A null array stays null."""
    words = tokens.flatten().dictionary_encode()
    stems = pa.array([None if w is None else _english_stem(w) for w in words.dictionary.to_pylist()], pa.string()).take(words.indices)
    sizes = [0 if n is None else n for n in tokens.value_lengths().to_pylist()]
    offsets = [0]
    for n in sizes:
        offsets.append(offsets[-1] + n)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), stems, mask=tokens.is_null())


@dataclass(frozen=True)
class Stemmer:
    """The stem of (word, known forms or null), and where it hangs on the word alone also those of a whole array of words."""

    word: Callable[[Column, Column], Column]
    arrays: Callable[[Column], Column] | None = None

    def __call__(self, word: Column, known: Column) -> Column:
        return self.word(word, known)


def rule_stemmer(rules: list[Rule]) -> Stemmer:
    return Stemmer(lambda word, known: suffix_stem(word, rules), lambda t: F.transform(t, lambda x: suffix_stem(x, rules)))


def english_stemmer() -> Stemmer:
    return Stemmer(lambda word, known: english_stems(word), english_stem_arrays)
