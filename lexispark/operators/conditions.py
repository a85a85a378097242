"""Preprocessing conditions: their files, checked in order, as plan functions for tokens, stopwords and stems."""

from __future__ import annotations

import hashlib
import json
import posixpath
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.functions import stemming as st
from lexispark.functions.text import tokens
from lexispark.operators import incidence as inc
from lexispark.session import written

CONFIG_VERSION = "1.0.0"
FIELDS = ("title", "body")


def tokeniser_errors(config: dict) -> list[str]:
    """What is wrong with a tokeniser's settings."""
    fields = config.get("indexed_fields") or []
    ratio = float(config.get("maximum_document_frequency_ratio", 0))
    checks = [
        ("config_version", config.get("config_version") == CONFIG_VERSION), ("unicode_form", config.get("unicode_form") == "NFC"), ("indexed_fields", bool(fields) and set(fields) <= set(FIELDS)), ("repeated_fields", len(fields) == len(set(fields))),
        ("minimum_letter_count", int(config.get("minimum_letter_count", 0)) >= 1), ("minimum_document_frequency", int(config.get("minimum_document_frequency", 0)) >= 1), ("maximum_document_frequency_ratio", 0 < ratio <= 1),
    ]
    return [name for name, ok in checks if not ok]


def checked(what: str, wrong: list[str]) -> None:
    if wrong:
        raise ValueError(f"{what}: {', '.join(wrong)}")


def stopwords_of(payload: dict, language: str, scope: str, plain: Callable[[list[str]], list[list[str]]]) -> set[str]:
    """The tokens that an approved list excludes. ``plain``: what each of some texts is tokenised to."""
    words = [unicodedata.normalize("NFC", e["token"]) for e in payload.get("entries", [])]
    checks = [
        ("language", payload.get("language") == language), ("scope", payload.get("scope") == scope), ("status", payload.get("status") == "approved"), ("review", bool(payload.get("reviewed_by") and payload.get("reviewed_at"))),
        ("repeated", len(words) == len(set(words))), ("token", all(got == [w] for w, got in zip(words, plain(words) if words else [], strict=True))), ("pending", all(e["decision"] != "pending" for e in payload.get("entries", []))),
    ]
    checked(f"stopwords of {language}", [name for name, ok in checks if not ok])
    return {w for w, e in zip(words, payload.get("entries", []), strict=True) if e["decision"] == "exclude_from_index"}


@dataclass
class Condition:
    """Tokeniser settings, stopwords and stemmers by language; what is not given is not done."""

    tokeniser: dict
    stopwords: dict[str, set[str]] = field(default_factory=dict)
    #: by language, the stems of (word, known forms or null); of a ``stemming.Stemmer`` with ``arrays``, tokens are stemmed where they lie
    stemmers: dict[str, Callable[[Column, Column], Column]] = field(default_factory=dict)
    #: by language, the forms that must be known before a stemmer may use them
    candidates: dict[str, Callable[[Column], Column]] = field(default_factory=dict)
    review: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        checked("tokeniser", tokeniser_errors(self.tokeniser))

    def tokens(self, text: Column) -> Column:
        c = self.tokeniser
        return tokens(text, int(c["minimum_letter_count"]), c.get("include_numeric_tokens", False), c.get("keep_internal_hyphen", False), c.get("casefold", True))

    def documents(self, docs: DataFrame, lexicon: DataFrame | None = None) -> DataFrame:
        """doc_id, lang, tokens, removed, changed. ``docs``: doc_id, lang and the indexed fields. ``lexicon``: token, the words known to guarded rules."""
        text = F.concat_ws("\n", *[F.coalesce(F.col(f), F.lit("")) for f in self.tokeniser["indexed_fields"]])
        tok = docs.select("doc_id", "lang", self.tokens(text).alias("tokens"))
        left = inc.remove_stopwords(tok, {k: sorted(v) for k, v in self.stopwords.items() if v})
        if not self.stemmers:
            return left.withColumn("changed", F.lit(0).cast("long"))
        whole = {lang: getattr(stem, "arrays", None) for lang, stem in self.stemmers.items()}
        if all(whole.values()) and not self.candidates:
            return inc.stem_in_place(left, whole)
        left = written(left, "tokens")
        stems = self._stems(left.select("lang", F.explode("tokens").alias("token")).distinct(), lexicon)
        return inc.apply_stem_table(left, stems).join(left.select("doc_id", "removed"), "doc_id")

    def _stems(self, words: DataFrame, lexicon: DataFrame | None) -> DataFrame:
        """lang, token, stem of the vocabulary."""
        words = written(words, "words")
        out = words.where(~F.coalesce(F.col("lang").isin(*self.stemmers), F.lit(False))).select("lang", "token", F.col("token").alias("stem"))
        for lang, stem in self.stemmers.items():
            own = words.where(F.col("lang") == lang)
            if lang in self.candidates:
                if lexicon is None:
                    raise ValueError("guarded rules need a lexicon")
                asked = own.select("token", F.explode(self.candidates[lang](F.col("token"))).alias("candidate"))
                known = asked.join(lexicon.select(F.col("token").alias("candidate")), "candidate", "left_semi").groupBy("token").agg(F.collect_set("candidate").alias("known"))  # a word's length at most
                own = own.join(known, "token", "left")
            else:
                own = own.withColumn("known", F.lit(None).cast("array<string>"))
            out = out.unionByName(own.select("lang", "token", stem(F.col("token"), F.col("known")).alias("stem")))
        return out

    def evaluate(self, annotations: DataFrame, lexicon: DataFrame | None = None) -> DataFrame:
        """language (null: all), items, correct, accuracy of the stems of annotated tokens. ``annotations``: language, token, expected_stem.

        Each item counts, repeated ones too; a language without a stemmer predicts the token itself.
        """
        words = annotations.select(F.col("language").alias("lang"), "token").distinct()
        stems = self._stems(words, lexicon).select(F.col("lang").alias("__l"), F.col("token").alias("__t"), "stem")
        met = annotations.join(stems, F.col("language").eqNullSafe(F.col("__l")) & (F.col("token") == F.col("__t")))
        right = (F.col("stem") == F.col("expected_stem")).cast("long")
        return met.select("language", right.alias("right")).rollup("language").agg(F.count(F.lit(1)).alias("items"), F.sum("right").alias("correct"), F.avg("right").alias("accuracy"))

    def vocabulary(self, documents: DataFrame) -> DataFrame:
        c = self.tokeniser
        return inc.vocabulary(documents, int(c["minimum_document_frequency"]), float(c["maximum_document_frequency_ratio"]))


class _Files:
    """Text files beside a configuration, read by Spark's file systems."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.root = spark, posixpath.dirname(posixpath.dirname(path))
        self.digests: dict[str, str] = {}

    def json(self, path: str) -> dict:
        rows = self.spark.read.text(path, wholetext=True).collect()  # one small file
        self.digests[path] = hashlib.sha256(rows[0].value.encode()).hexdigest()
        return json.loads(rows[0].value)

    def beside(self, name: str) -> str:
        return name if "://" in name or name.startswith("/") else f"{self.root}/{name}"


def load_condition(spark: SparkSession, path: str) -> tuple[Condition, dict | None]:
    """A condition from its configuration file, which names the files it rests on relative to the folder above its own.

    A plain tokeniser's settings; a stopword condition that names these and lists; or a stemming condition that names a stopword condition,
    specifications and perhaps a policy of execution. Every file is checked before use, a policy against the digests it names. Returns the
    condition and the word list of guarded rules (its file's content), if there is one.
    """
    files = _Files(spark, path)
    config = files.json(path)
    if "indexed_fields" in config:
        return Condition(config, review={"files": files.digests}), None
    checked("condition", [] if config.get("config_version") == CONFIG_VERSION else ["config_version"])
    if "stopword_lists" in config:
        tokeniser = files.json(files.beside(config["tokenisation_config"]))
        plain = Condition(tokeniser)

        def tokenised(words: list[str]) -> list[list[str]]:
            rows = spark.createDataFrame(list(enumerate(words)), "i int, w string").select("i", plain.tokens(F.col("w")).alias("t")).collect()  # a reviewed list
            return [r.t for r in sorted(rows, key=lambda r: r.i)]

        lists = {lang: stopwords_of(files.json(files.beside(name)), lang, config["required_scope"], tokenised) for lang, name in config["stopword_lists"].items()}
        return Condition(tokeniser, lists, review={"files": files.digests}), None
    base, _ = load_condition(spark, files.beside(config["stopword_condition"]))
    specs = {lang: files.json(files.beside(name)) for lang, name in config["stemmer_specifications"].items()}
    for lang, spec in specs.items():
        checked(f"stemmer of {lang}", st.validate_specification(spec, lang, config["required_scope"]))
        base.stemmers[lang] = _stemmer(spec)
    base.review["files"] |= files.digests
    lexicon = None
    if policy := config.get("mizo_execution_policy"):
        lexicon = _execute(base, files, specs["lus"], files.json(files.beside(policy)))
        base.review["files"] |= files.digests
    return base, lexicon


def _stemmer(spec: dict) -> Callable[[Column, Column], Column]:
    if spec["algorithm"] == st.ALGORITHMS["en"]:
        return st.english_stemmer()
    return st.rule_stemmer(st.rules_of(spec))


def _execute(condition: Condition, files: _Files, spec: dict, policy: dict) -> dict | None:
    """Replace a stemmer by the one that a policy of execution names; returns its word list."""
    rules = st.rules_of(spec)
    kind = (policy.get("policy_version"), policy.get("algorithm"))
    if kind == ("2.0.0", "reviewer_clarified_repeated_suffix"):
        checked("policy", [] if policy.get("exception_scope") == "current_form_per_rule" and policy.get("guarded_suffixes") == [] else ["exception_scope or guarded_suffixes"])
        evidence = files.json(files.beside(policy["clarification_record"]))
        checked("clarification", [] if evidence["source_sha256"] == policy["clarification_source_sha256"] else ["digest"])
        clarified = st.guarded_stemmer(rules, frozenset(), letters_only=True)
        condition.stemmers["lus"] = clarified
        return None
    checked("policy", [] if kind == ("1.0.0", "repeated_suffix_with_attestation") else ["policy_version or algorithm"])
    checked("policy", [] if policy.get("exception_scope") == "original_and_intermediate_per_rule" else ["exception_scope"])
    at = files.beside(policy["wordlist"])
    lexicon = files.json(at)
    guarded = frozenset(policy["guarded_suffixes"])
    checks = [("partition", lexicon.get("partition") == "auxiliary" and lexicon.get("language") == "lus"), ("digest", files.digests[at] == policy["wordlist_sha256"]), ("guarded_suffixes", guarded <= {r.suffix for r in rules})]
    checked("word list", [name for name, ok in checks if not ok])
    stem = st.guarded_stemmer(rules, guarded)
    condition.stemmers["lus"] = stem
    condition.candidates["lus"] = st.guarded_candidates(rules, guarded)
    return lexicon
