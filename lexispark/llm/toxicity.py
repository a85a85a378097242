"""Toxicity by a learned lexicon, Levenshtein automata over its trie, and context windows.

*Lexicon.* Of a bounded sample of labelled training rows, words (and word beginnings) are kept that stand in toxic
texts far more often than chance allows. Support is counted in distinct left neighbours, not in documents: a
word of a text that was copied a thousand times has one neighbour and so one vote.

*Matching.* The lexicon is a trie. A word matches exactly, by a beginning (an inner node that is itself significant), or,
if misspelled, by the intersection of the trie with the word's Levenshtein automaton: its states are sets of places in the word,
one set for each number of edits, kept as bits; a branch of the trie is left as soon as no place can be reached.

*Context.* A window of words around a match, and the quotation marks of the whole text, tell whether it is quoted, reported or
addressed to somebody. Matches of each of these kinds are summed once more on their own.

These sums are the features of a logistic regression, fitted on the same bounded sample; so it is the labels that say how much
a quoted or an addressed match counts.
"""

from __future__ import annotations

import math
import re
from bisect import bisect
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.llm.common import hash63, small_batches, written

#: most labelled rows that are learned from: bounds the lexicon and what reaches the driver
SAMPLE_ROWS = 20_000
FOLDS = 5
WINDOW = 6
#: letters of a beginning
HEAD_LETTERS = (4, 8)
_MEMO = 400_000
_WORD = re.compile(r"[^\W_]+")
# stand-ins for letters (fixed values)
_LEET = str.maketrans("013457", "oieast")
# words of reporting and of address in the corpus's languages (fixed values)
REPORT = frozenset("said says called calls word words term quote quoted quotes means dit mot terme citation sagte wort begriff zitat dijo palabra cita".split())
ADDRESS = frozenset("you your youre u ur tu vous toi te du dich ihr dir usted vosotros ti".split())
_QUOTE = re.compile("[\"“”„«»‹›]")


def crc_fold(column: str, folds: int):
    return F.crc32(F.col(column).cast("string")) % folds


class Trie:
    """Lexicon trie; ``find(word, k)`` walks it together with the Levenshtein automaton of ``word`` for at most k edits."""

    def __init__(self, words) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        for w in words:
            at = 0
            for ch in w:
                to = self.next[at].get(ch)
                if to is None:
                    to = self.next[at][ch] = len(self.next)
                    self.next.append({})
                    self.term.append(None)
                at = to
            self.term[at] = w

    def find(self, word: str, k: int, allowed: Callable[[int], int] | None = None) -> tuple[str, int] | None:
        """The term with the fewest edits (then the first in order), or None. ``allowed``: most edits of a term by its length."""
        n = len(word)
        at: dict[str, int] = {}
        for i, ch in enumerate(word):
            at[ch] = at.get(ch, 0) | 1 << i
        full, end = (1 << (n + 1)) - 1, 1 << n
        best: tuple[int, str] | None = None
        # a state is k + 1 sets of places in the word, those reached by 0, 1, ... k edits, each as bits of one number
        stack = [(0, tuple((1 << (e + 1)) - 1 & full for e in range(k + 1)))]
        while stack:
            node, state = stack.pop()
            if self.term[node] is not None:
                for e, places in enumerate(state):
                    if places & end and (allowed is None or e <= allowed(len(self.term[node]))):
                        got = (e, self.term[node])
                        if best is None or got < best:
                            best = got
                        break
            for ch, child in self.next[node].items():
                same = at.get(ch, 0)
                before, now = 0, 0
                to = []
                for places in state:
                    # the letter agrees; it is inserted, or put in another's place, or a letter of the word is left out after it
                    now = ((places & same) << 1 | before | before << 1 | now << 1) & full
                    to.append(now)
                    before = places
                if now:
                    stack.append((child, tuple(to)))
        return (best[1], best[0]) if best else None


def edits(term_length: int) -> int:
    return 0 if term_length < 5 else 1 if term_length < 9 else 2


@dataclass
class Lexicon:
    terms: dict[str, float] = field(default_factory=dict)
    heads: dict[str, float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        fuzzy = sorted(t for t in self.terms if edits(len(t)))
        self.trie = Trie(fuzzy)
        # cut in k + 1 pieces, a term keeps one of them through k edits: the first one where it was, the last one at the same
        # distance from the end, or (of two edits, one before it and one behind) the middle one, moved by one place at most
        self.pieces: set[tuple[int, int, str]] = set()
        for t in fuzzy:
            k = edits(len(t))
            size = len(t) // (k + 1)
            for n in range(len(t) - k, len(t) + k + 1):
                self.pieces |= {(n, 0, t[:size]), (n, n - len(t) + k * size, t[k * size :])}
                if k == 2:
                    self.pieces |= {(n, size + move, t[size : 2 * size]) for move in (-1, 0, 1)}
        self.spans: dict[int, list[tuple[int, int]]] = {}
        for n, at, piece in self.pieces:
            self.spans.setdefault(n, []).append((at, at + len(piece)))
        self.spans = {n: sorted(set(x)) for n, x in self.spans.items()}
        self.head_sizes = sorted({len(h) for h in self.heads})
        self.clean: set[str] = set()
        self.known: dict[str, tuple[int, float]] = {}

    def matches(self, words: list[str]) -> dict[str, tuple[int, float]]:
        """The words that match, each with (kind, weight): 1 exact, 2 by its beginning, 3 misspelled."""
        out = {}
        for w in set(words).difference(self.clean):
            got = self.known.get(w)
            if got is None:
                got = self._match(w)
                if got is None:
                    if len(self.clean) >= _MEMO:
                        self.clean.clear()
                    self.clean.add(w)
                    continue
                if len(self.known) >= _MEMO:
                    self.known.clear()
                self.known[w] = got
            out[w] = got
        return out

    def _match(self, word: str) -> tuple[int, float] | None:
        if word in self.terms:
            return 1, self.terms[word]
        for n in self.head_sizes:
            if word[:n] in self.heads:
                return 2, self.heads[word[:n]]
        plain = word.translate(_LEET) if not word.isalpha() else word
        if plain != word and plain in self.terms:
            return 3, self.terms[plain]
        n = len(plain)
        if any((n, i, plain[i:j]) in self.pieces for i, j in self.spans.get(n, ())):
            found = self.trie.find(plain, edits(n + 2), edits)
            if found:
                return 3, self.terms[found[0]]
        return None


FEATURES = 8


def features(text: str, lex: Lexicon) -> list[float]:
    """Logarithms of the sums of weights of exact matches, matches by beginning and misspelled ones, then of those quoted, reported
    and addressed; of matches spelled right the largest weight, and how many there are for each hundred words."""
    low = text.lower()
    words = _WORD.findall(low)
    hits = lex.matches(words)
    if not hits:
        return [0.0] * FEATURES
    sums, most, n = [0.0] * 6, 0.0, 0
    marks = [m.start() for m in _QUOTE.finditer(low)]
    starts = [m.start() for m in _WORD.finditer(low)] if marks else []
    for i, w in enumerate(words):
        got = hits.get(w)
        if got is None:
            continue
        kind, weight = got
        sums[kind - 1] += weight
        if marks:
            passed = bisect(marks, starts[i])
            if passed % 2 and passed < len(marks):
                sums[3] += weight
        near = words[max(0, i - WINDOW) : i] + words[i + 1 : i + 1 + WINDOW]
        if not REPORT.isdisjoint(near):
            sums[4] += weight
        if not ADDRESS.isdisjoint(near):
            sums[5] += weight
        if kind != 3:  # what a misspelling is worth is told by its own sum alone
            most = max(most, weight)
            n += 1
    return [*map(math.log1p, sums), most, min(10.0, 100.0 * n / len(words))]


def _sightings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        seen: set[tuple[str, int, int]] = set()
        for text, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            words = _WORD.findall((text or "").lower())
            for before, w in zip(["", *words], words, strict=False):
                seen.add((w, before, y))
        rows = list(seen)
        near = np.array([xxhash.xxh32_intdigest(r[1]) for r in rows], np.uint32).view(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array(near), pa.array([r[2] for r in rows], pa.int32())], names=["word", "near", "y"])


def _surprise(k, n, p):
    """Log-likelihood ratio of k toxic sightings among n against the base rate p (SQL columns)."""
    a = F.when(k > 0, k * F.log(k / (n * p))).otherwise(0.0)
    b = F.when(n > k, (n - k) * F.log((n - k) / (n * (1 - p)))).otherwise(0.0)
    return 2 * (a + b)


def learn_lexicon(sample: DataFrame) -> Lexicon:
    """``sample``: doc_id, text, y. Significant words and beginnings with their log odds."""
    seen = sample.select("doc_id", "text", "y").mapInArrow(_sightings, "word string, near int, y int").distinct()
    words = written(seen.groupBy("word").agg(F.sum("y").cast("double").alias("k"), F.count(F.lit(1)).cast("double").alias("n")), "words")
    k, n, kinds = words.agg(F.sum("k"), F.sum("n"), F.count(F.lit(1))).first()
    if not k or k == n:
        return Lexicon()
    p = k / n
    # among so many words, chance alone stays below twice the logarithm of their number
    least = 2 * math.log(kinds) + 8
    weight = F.least(F.lit(6.0), F.log((F.col("k") + 0.5) / (F.col("n") - F.col("k") + 0.5)) - math.log(p / (1 - p)))
    pick = lambda df, least, share: df.withColumn("g", _surprise(F.col("k"), F.col("n"), F.lit(p))).where((F.col("g") >= least) & (F.col("k") >= share * F.col("n"))).select("word", weight.alias("w"), "g")
    terms = pick(words, least, 0.6).collect()
    low, high = HEAD_LETTERS
    begin = words.where(F.length("word") > low).select(F.explode(F.transform(F.sequence(F.lit(low), F.least(F.lit(high), F.length("word") - 1)), lambda i: F.substring("word", F.lit(1), i))).alias("word"), "k", "n")
    begin = begin.groupBy("word").agg(F.sum("k").alias("k"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds")).where("kinds >= 3")
    heads = pick(begin, least + 6, 0.9).collect()
    kept: dict[str, float] = {}
    for r in sorted(heads, key=lambda r: (len(r.word), r.word)):
        if not any(r.word[:i] in kept for i in range(low, len(r.word))):
            kept[r.word] = float(r.w)
    return Lexicon({r.word: float(r.w) for r in terms}, kept)


@dataclass
class Model:
    lexicon: Lexicon
    center: np.ndarray
    scale: np.ndarray
    beta: np.ndarray

    def score(self, text: str | None) -> float:
        x = (np.array(features(text or "", self.lexicon)) - self.center) / self.scale
        return float(1.0 / (1.0 + np.exp(-np.clip(self.beta[0] + x @ self.beta[1:], -30, 30))))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Center, scale and coefficients by Newton's method with a ridge on the slopes."""
    center, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale == 0] = 1.0
    z = np.c_[np.ones(len(x)), (x - center) / scale]
    beta = np.zeros(z.shape[1])
    penalty = np.diag([1e-6] + [ridge] * x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve(z.T @ (z * w[:, None]) + penalty, z.T @ (y - p) - penalty @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return center, scale, beta


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on labelled rows outside the held-out fold, ``max_rows`` of them at most (but for chance), picked by a hash of doc_id.

    Rows without a label or identifier take no part; of several labels of one document the largest counts. Without
    rows, or with one class only, the score is that class's rate for every text.
    """
    spark = docs.sparkSession
    small_batches(spark)
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id is not null and y is not null")
    known = known.where(crc_fold("doc_id", FOLDS) != 0).groupBy("doc_id").agg(F.max("y").alias("y"))
    n = known.count()
    if n > max_rows:
        known = known.where(hash63(F.col("doc_id"), F.lit(5)) < int(max_rows / n * 2**63))
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # at most about max_rows pairs of numbers, so this side may be broadcast at any size of the corpus
    sample = written(src.join(F.broadcast(known), "doc_id").select("doc_id", "text", "y"), "sample").repartition(8 if n < 1000 else 48)
    lex = learn_lexicon(sample)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = [features(t or "", lex) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(f, pa.list_(pa.float64()))], names=["doc_id", "y", "f"])

    rows = sorted(sample.mapInArrow(measured, "doc_id long, y int, f array<double>").collect(), key=lambda r: (r.doc_id, r.f))
    y = np.array([r.y for r in rows], float)
    if not len(y) or y.min() == y.max():
        p = float(y.mean()) if len(y) else 0.0
        return Model(lex, np.zeros(FEATURES), np.ones(FEATURES), np.array([30.0 if p >= 0.5 else -30.0] + [0.0] * FEATURES))
    return Model(lex, *fit_logistic(np.array([r.f for r in rows]), y))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted, n_hits; with ``keep`` also these columns as they are.

    Null and empty texts have no matches and get the score of such texts. Whole texts are scored, in one pass.
    """
    small_batches(docs.sparkSession)
    keep = keep or []
    fields = {f.name: f for f in docs.schema.fields}
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("__text"), *[F.col(c).alias(f"__k{i}") for i, c in enumerate(keep)])
    extra = "".join(f", __k{i} {fields[c].dataType.simpleString()}" for i, c in enumerate(keep))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = [model.score(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), *b.columns[2:]], names=["doc_id", "score", *[f"__k{i}" for i in range(len(keep))]])

    out = src.mapInArrow(run, "doc_id long, score double" + extra)
    held = F.coalesce(crc_fold("doc_id", FOLDS) == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *[F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)])


def reject(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns, in one pass.

    Null and empty texts have no matches; repeated rows stay or go alike; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([model.score(t) < 0.5 for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
