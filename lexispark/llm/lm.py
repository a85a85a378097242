"""Language-model scores from Brown class-based bigrams beside a smoothed unigram base.

Tokens are words (runs without ASCII white space, A-Z lower-cased) and one end mark a text. All counts cover all
training texts: words are counted by 64-bit hash, pre-aggregated in each task. The most frequent words (a bounded
number, found from a histogram of counts) travel to the executors with their classes; those of all others stay
distributed, and the few tokens of each text outside that head are joined with them by hash.

Classes come from exchange clustering of the most frequent words: a word moves to the class that most raises the
mutual information of adjacent classes, until no word moves or the passes are used up. Every other word of the
training texts then goes to the class in which its own counts of neighbouring classes, distributed by word, raise it most. Both the number of
classes and that of the words exchanged grow with the vocabulary. A word that was never seen takes the class that has most words seen
once. The model's probability of a token is P(class | class before) P(word | class), both smoothed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.llm.common import small_batches, width, written

#: words that travel; least numbers of exchanged words and classes
HEAD, CLUSTERED, CLASSES, PASSES = 262_144, 1000, 64, 6
FOLDS, HELD = 7, 2
PRIOR = 50.0
#: no word has white space, so no word has this hash but by chance
END = np.uint64(xxhash.xxh3_64_intdigest(b"\n"))
_WORD_CACHE = 300_000


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _WORD_CACHE:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _WordHashes()


def tokens(raw: bytes | None) -> np.ndarray:
    """Hashes of the words, then the end mark."""
    words = (raw or b"").lower().split()
    out = np.empty(len(words) + 1, np.uint64)
    out[:-1] = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    out[-1] = END
    return out


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, c) of a task's texts; merged in memory up to a bound, then sent on."""
    h, c = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def out(h: np.ndarray, c: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(h), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(h[k : k + 100_000].view(np.int64)), pa.array(c[k : k + 100_000])], names=["h", "c"])

    for b in batches:
        x, n = np.unique(np.concatenate([tokens(t) for t in b.column(0).cast(pa.binary()).to_pylist()] or [h[:0]]), return_counts=True)
        both = np.concatenate([h, x])
        h, at = np.unique(both, return_inverse=True)
        c = np.bincount(at, np.concatenate([c, n]), len(h)).astype(np.int64)
        if len(h) > 1_000_000:
            yield from out(h, c)
            h, c = h[:0], c[:0]
    yield from out(h, c)


def sizes(kinds: int) -> tuple[int, int]:
    """Words to exchange and classes, for a vocabulary of so many words: classes grow with its cube root."""
    classes = max(CLASSES, round(kinds ** (1 / 3)))
    return max(CLUSTERED, 4 * classes), classes


@dataclass
class Head:
    """Words by sorted hash, their counts, and the column or class of each."""

    h: np.ndarray
    c: np.ndarray
    column: np.ndarray

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in the head and whether they are the words themselves."""
        if not len(self.h):
            return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        at = np.minimum(np.searchsorted(self.h, x), len(self.h) - 1)
        return at, self.h[at] == x

    def columns(self, x: np.ndarray, other: int) -> np.ndarray:
        at, own = self.find(x)
        return np.where(own, self.column[at], other) if len(self.h) else np.full(len(x), other)


def make_head(h: np.ndarray, c: np.ndarray, column: np.ndarray) -> Head:
    by = np.argsort(h)
    return Head(h[by], c[by], column[by])


def _packed(row: np.ndarray) -> bytes:
    """A row of counts: its length, then all of them, or the places and counts of those that are not 0 if that is shorter."""
    some = np.flatnonzero(row)
    few = 12 * len(some) < 8 * len(row)
    body = some.astype(np.int32).tobytes() + row[some].tobytes() if few else row.tobytes()
    return np.array([len(row), len(some) if few else -1], np.int32).tobytes() + body


def _add(total: np.ndarray | None, blob: bytes) -> np.ndarray:
    """``total`` (a row of counts, or None) and a packed row."""
    size, some = np.frombuffer(blob, np.int32, 2)
    if total is None:
        total = np.zeros(size, np.int64)
    if some < 0:
        total += np.frombuffer(blob, np.int64, size, 8)
    else:
        total[np.frombuffer(blob, np.int32, some, 8)] += np.frombuffer(blob, np.int64, some, 8 + 4 * some)
    return total


def _vectors(table: np.ndarray) -> Iterator[pa.RecordBatch]:
    some = np.flatnonzero(table.any(axis=1))
    for k in range(0, len(some), 64):
        r = some[k : k + 64]
        yield pa.RecordBatch.from_arrays([pa.array(r.astype(np.int32)), pa.array([_packed(table[i]) for i in r], pa.binary())], names=["r", "v"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Tokens of some texts at a time, one after the other; each text ends in the end mark, so the next one starts after it."""
    for b in batches:
        for k in range(0, b.num_rows, 128):
            yield np.concatenate([tokens(t) for t in b.column(0).slice(k, 128).cast(pa.binary()).to_pylist()])


def _adjacent(seeds):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s: Head = seeds.value
        size = len(s.h) + 1  # the last column is that of all other words
        end = int(s.columns(np.array([END]), size - 1)[0])
        table = np.zeros(size * size, np.int64)
        for x in _texts(batches):
            col = s.columns(x, size - 1)
            before = np.empty_like(col)
            before[1:], before[0] = col[:-1], end
            table += np.bincount(before * size + col, minlength=len(table))
        yield from _vectors(table.reshape(size, size))

    return run


def _neighbours(seeds, total: int):
    """(h, j, n) of the words that are not exchanged: how often a class j follows them, or (from ``total`` on) stands before them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s: Head = seeds.value
        end = int(s.columns(np.array([END]), total - 1)[0])
        parts: list[tuple[np.ndarray, ...]] = []
        held = 0

        def merged() -> tuple[np.ndarray, ...]:
            h, j, n = (np.concatenate(x) for x in zip(*parts, strict=True))
            word, at = np.unique(h, return_inverse=True)
            code, to = np.unique(at * (2 * total) + j, return_inverse=True)
            return word[code // (2 * total)], code % (2 * total), np.bincount(to, n, len(code)).astype(np.int64)

        def out() -> Iterator[pa.RecordBatch]:
            h, j, n = merged()
            for k in range(0, len(h), 100_000):
                e = k + 100_000
                yield pa.RecordBatch.from_arrays([pa.array(h[k:e].view(np.int64)), pa.array(j[k:e].astype(np.int32)), pa.array(n[k:e])], names=["h", "j", "n"])

        for x in _texts(batches):
            at, own = s.find(x)
            cls = np.where(own, s.column[at], total - 1) if len(s.h) else np.full(len(x), total - 1)
            before, after = np.r_[end, cls[:-1]], np.r_[cls[1:], cls[0]]
            w = np.flatnonzero(~own)
            h = np.concatenate([x[w], x[w]])
            j = np.concatenate([after[w], total + before[w]])
            parts.append((h, j, np.ones(len(h), np.int64)))
            held += len(h)
            if held > 1_000_000:
                parts = [merged()]
                held = len(parts[0][0])
                if held > 500_000:
                    yield from out()
                    parts, held = [], 0
        if parts:
            yield from out()

    return run


def _rise(x: np.ndarray, n) -> np.ndarray:
    """Rise of x log x as x becomes x + n."""
    f = lambda x: x * np.log(np.maximum(x, 1.0))
    return f(x + n) - f(x)


def best_classes(m: np.ndarray, k: int, start: np.ndarray, j: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Class, of the first k, that each word raises most. ``m``: adjacent classes; ``start``: where each word's neighbours (j, n) begin."""
    total = len(m)
    cell = np.vstack([m[:k].T, m[:, :k]])
    val = np.empty((len(j), k))
    for few in range(1, 4):
        at = n == few
        val[at] = _rise(cell, few)[j[at]]
    at = n > 3
    val[at] = _rise(cell[j[at]], n[at][:, None])
    gain = np.add.reduceat(val, start, axis=0)
    a, b = np.add.reduceat(np.where(j < total, n, 0), start), np.add.reduceat(np.where(j < total, 0, n), start)
    return np.argmax(gain - _rise(m.sum(axis=1)[None, :k], a[:, None]) - _rise(m.sum(axis=0)[None, :k], b[:, None]), axis=1)


def _assigned(m: np.ndarray, k: int):
    """Rows (h, j, n) sorted by h and j: (h, c, cls)."""
    total = len(m)

    def summed(h: np.ndarray, j: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        new = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (j[1:] != j[:-1])])
        return h[new], j[new], np.add.reduceat(n, new)

    def some(h: np.ndarray, j: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        c = np.add.reduceat(np.where(j < total, 0, n), start)
        return pa.RecordBatch.from_arrays([pa.array(h[start]), pa.array(c), pa.array(best_classes(m, k, start, j, n).astype(np.int32))], names=["h", "c", "cls"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, held = [], 0
        for b in batches:
            left.append([b.column(i).to_numpy() for i in range(3)])
            held += b.num_rows
            if held >= 32_768:
                # a word has two rows a class at most once its rows are summed, however many tasks it came from
                h, j, n = summed(*(np.concatenate(x) for x in zip(*left, strict=True)))
                cut = int(np.searchsorted(h, h[-1]))  # the last word may go on
                if cut:
                    yield some(h[:cut], j[:cut], n[:cut])
                left, held = [[h[cut:], j[cut:], n[cut:]]], len(h) - cut
        if held:
            yield some(*summed(*(np.concatenate(x) for x in zip(*left, strict=True))))

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by r: the sum of their vectors, one row a number; one vector in memory."""
    at, total = None, None

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([_packed(total)], pa.binary())], names=["r", "v"])

    for b in batches:
        for r, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if r != at:
                if at is not None:
                    yield out()
                at, total = r, None
            total = _add(total, v)
    if at is not None:
        yield out()


def exchange(table: np.ndarray, words: int, classes: int, passes: int = PASSES) -> np.ndarray:
    """Class of each column: ``words`` columns are clustered by exchange, the others stay classes of their own."""
    n = len(table)
    k = min(classes, words)
    own = np.empty(n, np.int64)
    own[:words] = np.arange(words) % max(k, 1)
    own[words:] = k + np.arange(n - words)
    total = k + n - words
    f = lambda x: x * np.log(np.maximum(x, 1.0))
    pick = np.zeros((n, total))
    pick[np.arange(n), own] = 1
    g = table.astype(float)
    right, left = g @ pick, (pick.T @ g).T  # of a word: followers by class, forerunners by class
    m = pick.T @ g @ pick
    cand = np.arange(k)
    for _ in range(passes):
        moved = 0
        for w in range(words):
            r, q, s, was = right[w].copy(), left[w].copy(), g[w, w], own[w]
            if not r.sum() + q.sum():
                continue
            r[was] -= s
            q[was] -= s
            m[was] -= r
            m[:, was] -= q
            m[was, was] -= s
            rows, cols = m.sum(axis=1), m.sum(axis=0)
            a, b = r.sum() + s, q.sum() + s
            gain = (f(m[:k] + r) - f(m[:k])).sum(axis=1) + (f(m[:, :k].T + q) - f(m[:, :k].T)).sum(axis=1)
            d = m[cand, cand]
            gain += f(d + r[cand] + q[cand] + s) - f(d + r[cand]) - f(d + q[cand]) + f(d)
            gain -= f(rows[:k] + a) - f(rows[:k]) + f(cols[:k] + b) - f(cols[:k])
            to = int(np.argmax(gain))
            if gain[to] <= gain[was] + 1e-9:
                to = int(was)
            m[to] += r
            m[:, to] += q
            m[to, to] += s
            if to != was:
                moved += 1
                own[w] = to
                right[:, was] -= g[:, w]
                right[:, to] += g[:, w]
                left[:, was] -= g[w]
                left[:, to] += g[w]
        if not moved:
            break
    return own


@dataclass
class Model:
    step: np.ndarray  # log10 P(class | class before)
    room: np.ndarray  # log10 of the smoothed token total of each class
    end: int
    n: int
    v: int


def _square(rows: DataFrame, size: int) -> np.ndarray:
    """Sum of the tasks' tables, whose size the corpus's length does not change."""
    table = np.zeros((size, size), np.int64)
    spark = rows.sparkSession
    for r in rows.repartition(min(width(spark), 64), "r").sortWithinPartitions("r").mapInArrow(_summed, "r int, v binary").collect():
        _add(table[r.r], r.v)
    return table


def classed(src: DataFrame, vocab: DataFrame, kinds: int) -> tuple[Head, DataFrame, int]:
    """The exchanged words with their classes, the table (h, c, cls) of all other words, and the number of classes."""
    spark = src.sparkSession
    words, classes = sizes(kinds)
    top = vocab.orderBy(F.desc("c"), "h").limit(words).toArrow()
    h, c = top.column("h").to_numpy().view(np.uint64), top.column("c").to_numpy()
    seeds = make_head(h, c, np.arange(len(h)))
    table = _square(src.mapInArrow(_adjacent(spark.sparkContext.broadcast(seeds)), "r int, v binary"), len(h) + 1)
    of = exchange(table, len(h), classes)
    k, total = min(classes, len(h)), int(of.max()) + 1
    pick = np.zeros((len(of), total))
    pick[np.arange(len(of)), of] = 1
    seeds = Head(seeds.h, seeds.c, of[seeds.column])
    shape = "h long, c long, cls int"
    if not k:
        return seeds, spark.createDataFrame([], shape), 1
    near = src.mapInArrow(_neighbours(spark.sparkContext.broadcast(seeds), total), "h long, j int, n long")
    rest = near.repartition(width(spark), "h").sortWithinPartitions("h", "j").mapInArrow(_assigned(pick.T @ table @ pick, k), shape)
    return seeds, written(rest, "classes"), k


def _encoded(head):
    """Class of each token of a text as 16-bit numbers, -1 for words outside the head, which are listed with their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hd: Head = head.value
        log = np.log10(hd.c + 1.0)
        for b in batches:
            for k in range(0, b.num_rows, 128):
                rows = b.slice(k, 128)
                parts = [tokens(t) for t in rows.column(2).cast(pa.binary()).to_pylist()]
                x, n = np.concatenate(parts), np.array([len(p) for p in parts])
                ends = np.cumsum(n)
                starts = ends - n
                at, own = hd.find(x)
                cls = (np.where(own, hd.column[at], -1) if len(hd.h) else np.full(len(x), -1)).astype(np.int16)
                seen = np.add.reduceat(np.where(own, log[at], 0.0) if len(hd.h) else np.zeros(len(x)), starts)
                known = np.add.reduceat(own.astype(np.int64), starts)
                out = np.flatnonzero(~own)
                places = (out - np.repeat(starts, n)[out]).astype(np.int32)
                tail = pa.StructArray.from_arrays([pa.array(x[out].view(np.int64)), pa.array(places)], names=["h", "i"])
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n - known)].astype(np.int32)), tail)
                binary = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((np.r_[0, ends] * 2).astype(np.int32).tobytes()), pa.py_buffer(cls.tobytes())])
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(n, pa.int64()), pa.array(known), pa.array(seen), binary, lists], names=["row", "doc_id", "n_tokens", "known", "seen", "cls", "tail"])

    return run


def _filled(unseen: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for cls, at, to in zip(b.column(4).to_pylist(), b.column(5).to_pylist(), b.column(6).to_pylist(), strict=True):
                x = np.frombuffer(cls, np.int16).copy()
                if at:
                    x[at] = to
                x[x < 0] = unseen
                out.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(out, pa.binary())], names=["doc_id", "n_tokens", "known", "seen", "cls"])

    return run


def _steps(k: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(k * k, np.int64)
        for b in batches:
            x = np.frombuffer(b"".join(b.column(0).to_pylist()), np.int16).astype(np.int64)
            if len(x):  # each text ends in the end mark, so the next one starts after it
                table += np.bincount(np.r_[end, x[:-1]] * k + x, minlength=k * k)
        yield from _vectors(table.reshape(k, k))

    return run


def _scored(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        whole = math.log10(m.n + m.v + 1)
        for b in batches:
            base, score = [], []
            for cls, n, seen in zip(b.column(4).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True):
                x = np.frombuffer(cls, np.int16).astype(np.int64)
                base.append(seen - n * whole)
                score.append(float(m.step[np.r_[m.end, x[:-1]], x].sum() - m.room[x].sum() + seen))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(base, pa.float64()), pa.array(score, pa.float64())], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return run


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", head_words: int = HEAD) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows whose crc32(doc_id as text) mod 7 is not 2 (a null doc_id is held out). Null and empty
    texts are one end mark. Repeated rows are counted and scored as often as they occur. Without training rows
    all counts are 0. Other columns are ignored. ``head_words`` travel to the executors; the result is the same with any number.
    """
    spark = docs.sparkSession
    small_batches(spark)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD, F.lit(True))
    training = src.where(~held).select("text")
    vocab = written(training.mapInArrow(_counts, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")), "words")
    n, v = vocab.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    seeds, others, k = classed(training, vocab, int(v))

    band = F.floor(F.log2(F.col("c").cast("double")) * 8).cast("int")
    above, least = 0, None
    for b, size in sorted(others.groupBy(band.alias("b")).count().collect(), reverse=True):  # some 500 bands at most
        if above + size > head_words or b < 8:  # words seen once are many and met rarely
            break
        above, least = above + size, b
    inside = (band >= least) if least is not None else F.lit(False)
    top = others.where(inside).toArrow()  # head_words rows of 20 bytes at most
    head = make_head(np.r_[seeds.h, top.column("h").to_numpy().view(np.uint64)], np.r_[seeds.c, top.column("c").to_numpy()], np.r_[seeds.column, top.column("cls").to_numpy()])
    kinds, tokens_of, once = np.bincount(seeds.column, minlength=k), np.bincount(seeds.column, seeds.c, k), np.bincount(seeds.column, seeds.c == 1, k)
    for r in others.groupBy("cls").agg(F.count(F.lit(1)).alias("kinds"), F.sum("c").alias("c"), F.sum((F.col("c") == 1).cast("long")).alias("once")).collect():  # one row a class
        kinds[r.cls] += r.kinds
        tokens_of[r.cls] += r.c
        once[r.cls] += r.once
    unseen = int(np.argmax(once)) if once.any() else int(np.argmin(tokens_of))
    end = END.astype(np.int64).item()
    rare = others.where(~inside)
    at_end = [int(x) for x in head.columns(np.array([END]), -1)] if len(head.h) else [-1]
    if at_end[0] < 0:
        at_end = [r.cls for r in rare.where(F.col("h") == end).collect()] or [unseen]

    shape = "row long, doc_id long, n_tokens long, known long, seen double, cls binary, tail array<struct<h: long, i: int>>"
    rows = written(src.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(_encoded(spark.sparkContext.broadcast(head)), shape), "encoded")
    open_ = rows.select("row", F.explode("tail").alias("t")).select("row", "t.h", "t.i")
    met = open_.join(rare, "h").groupBy("row").agg(F.count(F.lit(1)).alias("more"), F.sum(F.log10(F.col("c") + 1.0)).alias("gain"), F.collect_list(F.struct("i", "cls")).alias("fill"))
    both = rows.drop("tail").join(met, "row", "left")
    both = both.select("doc_id", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("known"), (F.col("seen") + F.coalesce("gain", F.lit(0.0))).alias("seen"), "cls", F.col("fill.i").alias("at"), F.col("fill.cls").alias("to"))
    whole = written(both.mapInArrow(_filled(unseen), "doc_id long, n_tokens long, known long, seen double, cls binary"), "filled")
    pairs = _square(whole.where(~held).select("cls").mapInArrow(_steps(k, at_end[0]), "r int, v binary"), k)
    unigram = (pairs.sum(axis=0) + 1) / (pairs.sum() + k)
    step = np.log10((pairs + PRIOR * unigram) / (pairs.sum(axis=1, keepdims=True) + PRIOR))
    sent = spark.sparkContext.broadcast(Model(step, np.log10(tokens_of + kinds + 1), at_end[0], int(n), int(v)))
    out = whole.mapInArrow(_scored(sent), "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(int(n)).cast("long").alias("train_tokens"), "base_score", "score")
