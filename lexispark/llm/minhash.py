"""Near-duplicate documents by HyperMinHash sketches, banding and verification on full shingle sets.

Each document's set of 5-word shingles is sketched by ``REGISTERS`` buckets. A bucket keeps the minimum of one hash
function over the set in 16 bits: the count of its leading zeros (6 bits) and the next 10 bits, the mantissa. (One
function a bucket, rather than one function dealt over all buckets, for a short text would leave most buckets empty.)
Bands of three compressed registers are the keys of buckets of candidates. Two documents at the threshold share at
least one of 32 bands but for 1 pair in 40 million: (1 - 0.75^3)^32 = 2.4e-8.

No bucket's pairs are emitted as such:

* documents with equal sets are one representative from the start;
* every member of a bucket is compared with the bucket's smallest member only (a star), and the verified links are
  joined to components. Buckets that lie within one component are done;
* in the buckets that are left, pairs across components are screened by the collision-corrected estimate of the
  Jaccard similarity if the bucket is small; the members of large buckets are dealt into blocks of bounded size, and
  pairs of blocks that meet in a bucket are intersected exactly, in place, giving at most one link a document.

All links are confirmed on the full sets (64-bit shingle hashes) before they count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.llm.common import hash63, small_batches, width, written
from lexispark.llm.components import connected_components

WORDS, NUM, DEN = 5, 75, 100
REGISTERS, ROWS = 96, 3
BANDS = REGISTERS // ROWS
#: 5.6 standard errors of the estimate below the threshold: a true link is screened out once in 10^8
SCREEN = 0.75 - 5.6 * (0.75 * 0.25 / REGISTERS) ** 0.5
SMALL_BUCKET, BLOCK, FAN = 32, 512, 256
#: shingles of a block
BLOCK_SHINGLES = 1_000_000
_WORD_CACHE = 300_000
_rng = np.random.default_rng(20_24)
_MUL = _rng.integers(0, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, REGISTERS, dtype=np.uint64)
_PLACE = _rng.integers(0, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _WORD_CACHE:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _WordHashes()


def shingles(text: str | bytes | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's 5-word shingles (words: runs without ASCII white space, A-Z lower-cased).

    With fewer than five words the whole sequence is the one shingle; without words the set is empty.
    """
    raw = text.encode() if isinstance(text, str) else text or b""
    words = raw.lower().split()  # of bytes: white space and letters of ASCII only
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < WORDS:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    n = len(h) - WORDS + 1
    x = h[:n] * _PLACE[0]
    for i in range(1, WORDS):
        x += h[i : n + i] * _PLACE[i]
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x.sort()
    keep = np.empty(n, bool)
    keep[0] = True
    np.not_equal(x[1:], x[:-1], out=keep[1:])
    return x[keep]


def registers(x: np.ndarray) -> np.ndarray:
    """Compressed minima (uint16) of a non-empty set: leading zeros and mantissa bits of each bucket."""
    low = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    step = 256
    room = np.empty((min(step, len(x)), REGISTERS), np.uint64)
    for k in range(0, len(x), step):
        part = x[k : k + step]
        y = room[: len(part)]
        np.multiply(part[:, None], _MUL, out=y)
        y += _ADD
        np.minimum(low, y.min(axis=0), out=low)
    part, power = np.frexp(low.astype(np.float64))
    zeros = np.clip(64 - power, 0, 63).astype(np.uint16)
    return zeros * np.uint16(1024) + np.minimum((part * 2 - 1) * 1024, 1023).clip(0).astype(np.uint16)


def band_keys(regs: np.ndarray) -> np.ndarray:
    r = regs.reshape(BANDS, ROWS).astype(np.int64)
    return r[:, 0] | (r[:, 1] << 16) | (r[:, 2] << 32) | (np.arange(BANDS, dtype=np.int64) << 48)


def collision(n: np.ndarray | float, m: np.ndarray | float) -> np.ndarray:
    """Chance that a bucket's registers of two disjoint sets of n and m shingles agree by compression alone."""
    n, m = np.atleast_1d(np.asarray(n, float)), np.atleast_1d(np.asarray(m, float))
    edge = 2.0 ** -np.arange(0, 65)
    with np.errstate(under="ignore"):
        stay = lambda k: np.exp(k[:, None] * np.log1p(-np.minimum(edge, 1 - 1e-16)))  # noqa: E731  chance that the minimum is above
        pn, pm = np.diff(stay(n), axis=1), np.diff(stay(m), axis=1)
    return (pn * pm).sum(axis=1) / 1024


def estimate(agree: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the share of agreeing registers, corrected for collisions."""
    c = collision(n, m)
    return (agree - c) / (1 - c)


def linked(common: int | np.ndarray, n: int | np.ndarray, m: int | np.ndarray):
    return DEN * common >= NUM * (n + m - common)


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n, digest, regs, keys = [], [], [], []
        for t in b.column(1).cast(pa.binary()).to_pylist():
            x = shingles(t)
            n.append(len(x))
            if len(x):
                r = registers(x)
                digest.append(xxhash.xxh3_128_digest(x.tobytes()))
                regs.append(r.tobytes())
                keys.append(band_keys(r))
            else:
                digest.append(None), regs.append(None), keys.append(None)
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(regs, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "n", "digest", "regs", "keys"]
        )


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (center, salt, role): the center's text, then the members to be compared with it."""
    at, mine, own = None, None, None
    for b in batches:
        out_a, out_b = [], []
        center, role, ids = (b.column(i).to_pylist() for i in (0, 2, 3))
        texts, regs = b.column(4).cast(pa.binary()).to_pylist(), b.column(5).to_pylist()
        for c, r, i, t, g in zip(center, role, ids, texts, regs, strict=True):
            if r == 0:
                if at != c:
                    at, mine, own = c, shingles(t), np.frombuffer(g, np.uint16)
                continue
            if at != c:
                continue
            theirs = np.frombuffer(g, np.uint16)
            if (own == theirs).mean() < SCREEN - 0.01:
                continue
            x = shingles(t)
            if linked(len(np.intersect1d(mine, x, assume_unique=True)), len(mine), len(x)):
                out_a.append(i), out_b.append(c)
        yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])


def _verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Of the pairs (member, center), those that are links. A center with many members is copied once for each FAN of them."""
    many = pairs.groupBy("center").agg(F.count(F.lit(1)).alias("k")).withColumn("k", F.ceil(F.col("k") / FAN).cast("int"))
    t = texts.select(F.col("doc_id").alias("id"), "text", "regs")
    heads = many.join(t, many["center"] == t["id"]).select("center", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("salt"), F.lit(0).alias("role"), "id", "text", "regs")
    members = pairs.join(many, "center").select("center", F.pmod(F.xxhash64("member"), F.col("k")).cast("int").alias("salt"), F.lit(1).alias("role"), "member")
    members = members.join(t, members["member"] == t["id"]).select("center", "salt", "role", "id", "text", "regs")
    return heads.union(members).repartition(width(pairs.sparkSession), "center", "salt").sortWithinPartitions("center", "salt", "role").mapInArrow(_verified, "a long, b long")


def _screened(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Small buckets, sorted by key: pairs across components whose estimate reaches the screen."""
    left = None
    for b in batches:
        b = b if left is None else pd.concat([left, b], ignore_index=True)
        key = b["key"].to_numpy()
        cut = int(np.searchsorted(key, key[-1])) if len(key) else 0
        left, b = b.iloc[cut:], b.iloc[:cut]
        yield from _screen(b)
    if left is not None and len(left):
        yield from _screen(left)


def _screen(b: pd.DataFrame) -> Iterator[pd.DataFrame]:
    if not len(b):
        return
    key, ids, comp, n = (b[c].to_numpy() for c in ("key", "doc_id", "component", "n"))
    regs = np.frombuffer(b"".join(b["regs"]), np.uint16).reshape(len(b), REGISTERS)
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    ends = np.r_[starts[1:], len(key)]
    lo, hi = [], []
    for s, e in zip(starts, ends, strict=True):
        i, j = np.triu_indices(e - s, 1)
        ok = comp[s + i] != comp[s + j]
        lo.append(s + i[ok]), hi.append(s + j[ok])
    i, j = np.concatenate(lo), np.concatenate(hi)
    if not len(i):
        return
    good = estimate((regs[i] == regs[j]).mean(axis=1), n[i], n[j]) >= SCREEN
    i, j = i[good], j[good]
    yield pd.DataFrame({"member": np.maximum(ids[i], ids[j]), "center": np.minimum(ids[i], ids[j])}).drop_duplicates()


def _block_links(pdf: pd.DataFrame) -> pd.DataFrame:
    """Two blocks of documents (or one with itself): exact intersections of all pairs across components, joined to a forest of links."""
    pdf = pdf.drop_duplicates("doc_id").reset_index(drop=True)
    left = np.flatnonzero(pdf["block"] == pdf["one"])
    right = np.flatnonzero(pdf["block"] == pdf["two"])
    sets = [shingles(t) for t in pdf["text"]]
    size = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), size)
    _, col, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times[col] > 1
    col, owner = np.unique(col[shared], return_inverse=True)[1], owner[shared]
    order = np.argsort(col, kind="stable")
    col, owner = col[order], owner[order]
    common = np.zeros((len(sets), len(sets)), np.float32)
    step = 4096
    for k in range(0, int(col[-1]) + 1 if len(col) else 0, step):
        s, e = np.searchsorted(col, [k, k + step])
        m = np.zeros((len(sets), step), np.float32)
        m[owner[s:e], col[s:e] - k] = 1
        common += m @ m.T
    comp = pdf["component"].to_numpy()
    hit = linked(common, size[:, None], size[None, :])[np.ix_(left, right)] & (comp[left][:, None] != comp[right][None, :])
    head: dict[int, int] = {}

    def root(x: int) -> int:
        while head.get(x, x) != x:
            x = head[x]
        return x

    out = []
    ids = pdf["doc_id"].to_numpy()
    for i, j in zip(*np.nonzero(hit), strict=True):
        x, y = root(comp[left[i]]), root(comp[right[j]])
        if x != y:
            head[max(x, y)] = min(x, y)
            out.append((ids[left[i]], ids[right[j]]))
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def _near_rows(src: DataFrame) -> DataFrame:
    """``near_dedup`` of a table in which an identifier stands for several texts: of the rows first, then of their identifiers."""
    rows = written(src.withColumn("row", F.monotonically_increasing_id()), "rows")
    found = written(near_dedup(rows, id_col="row").select(F.col("doc_id").alias("row"), "n_shingles", "component_id"), "row-components")
    of = rows.where("doc_id is not null").select("row", "doc_id").join(found, "row")
    # identifiers of one component are linked through its smallest one, and one identifier links the components of its texts
    low = of.where("n_shingles > 0").groupBy("component_id").agg(F.min("doc_id").alias("low"))
    links = of.where("n_shingles > 0").join(low, "component_id").select(F.col("doc_id").alias("a"), F.col("low").alias("b"))
    final = connected_components(written(links.distinct(), "id-links"))
    out = rows.select("row", "doc_id").join(found.select("row", "n_shingles"), "row").join(final, F.col("doc_id") == F.col("node"), "left")
    whole = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", whole.alias("component_id"), F.coalesce(whole == F.col("doc_id"), F.lit(False)).alias("kept"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles (size of its set), component_id, kept.

    Documents are linked if 100 * intersection >= 75 * union of their shingle sets; component_id is the smallest
    doc_id reachable. Null and empty texts, and texts without words, have no shingles and are linked with nothing.
    Rows repeated with one doc_id and different texts are one node with the links of all. A null doc_id takes
    no part: component_id is null and kept false. An empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    base = written(src.mapInArrow(_sketched, "doc_id long, n long, digest binary, regs binary, keys array<long>"), "sketches")
    some = base.where(F.col("digest").isNotNull() & F.col("doc_id").isNotNull())
    per = some.groupBy("doc_id").agg((F.min("digest") != F.max("digest")).alias("several"), (F.count(F.lit(1)) > 1).alias("again"))
    several, again = per.agg(F.max("several"), F.max("again")).first()
    if several:
        return _near_rows(src)
    reps = some.groupBy("digest").agg(F.min("doc_id").alias("rep"))
    keyed = some.join(reps, (some["digest"] == reps["digest"]) & (some["doc_id"] == reps["rep"]), "left_semi")
    rows = keyed.select("doc_id", "n", F.explode("keys").alias("key")).distinct()
    buckets = rows.groupBy("key").agg(F.min("doc_id").alias("center"), F.count(F.lit(1)).alias("size")).where("size > 1")
    hot = written(rows.join(buckets, "key"), "buckets")
    wanted = hot.select("doc_id").distinct()
    sketch = keyed.select("doc_id", "n", "regs", "digest").dropDuplicates(["doc_id"])
    # repeated rows need their text once; without any, no text is shuffled to see that
    once = src.where("text is not null").dropDuplicates(["doc_id"]) if again else src
    texts = written(wanted.join(once, "doc_id").join(sketch, "doc_id"), "texts")
    stars = hot.where("doc_id <> center").select(F.col("doc_id").alias("member"), "center").distinct()
    links = written(_verify(stars, texts), "stars")
    found = connected_components(links)

    # what the stars leave open
    comp = found.withColumnRenamed("node", "doc_id")
    labelled = hot.join(comp, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    open_keys = labelled.groupBy("key").agg(F.min("component").alias("c1"), F.max("component").alias("c2")).where("c1 <> c2").select("key")
    left = written(labelled.join(open_keys, "key"), "open")
    n = width(spark)
    small = left.where(F.col("size") <= SMALL_BUCKET).join(texts.select("doc_id", "regs"), "doc_id").select("key", "doc_id", "component", "n", "regs")
    pairs = small.repartition(n, "key").sortWithinPartitions("key").mapInPandas(_screened, "member long, center long").distinct()
    more = _verify(written(pairs, "pairs"), texts)

    # each document's home is the largest bucket it is in; all its keys (BANDS at most) stay with it
    large = left.where(F.col("size") > SMALL_BUCKET)
    home = large.groupBy("doc_id", "component").agg(F.max_by("key", F.struct("size", "key")).alias("home"), F.first("n").alias("n"), F.collect_list("key").alias("keys"))
    room = home.groupBy("home").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("parts"))
    block = home.join(room, "home").select("doc_id", "component", "keys", F.xxhash64("home", F.pmod(hash63("doc_id"), "parts")).alias("block"))
    block = written(block, "blocks")
    meet = block.select(F.explode("keys").alias("key"), "block", "component").groupBy("key", "block").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    one, two = meet.select("key", F.col("block").alias("one"), F.col("lo").alias("l1"), F.col("hi").alias("h1")), meet.select("key", F.col("block").alias("two"), F.col("lo").alias("l2"), F.col("hi").alias("h2"))
    duo = one.join(two, "key").where((F.col("one") <= F.col("two")) & (F.least("l1", "l2") < F.greatest("h1", "h2"))).groupBy("one", "two").agg(F.collect_list("key").alias("shared"))
    duo = written(duo, "meetings")
    side = duo.select("one", "two", "shared", F.explode(F.array_distinct(F.array("one", "two"))).alias("of"))
    # of two blocks that meet, only the documents in the buckets they share
    filled = side.join(block, (side["of"] == block["block"]) & F.arrays_overlap("keys", "shared")).drop("keys", "shared", "of").join(texts.select("doc_id", "text"), "doc_id")
    rest = filled.groupBy("one", "two").applyInPandas(_block_links, "a long, b long")

    final = connected_components(written(links.union(more).union(rest), "all-links"))
    named = reps.join(final, reps["rep"] == final["node"], "left").select("digest", F.least("rep", F.coalesce("component", "rep")).alias("component_id"))
    out = base.join(named, "digest", "left")
    whole = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), whole.alias("component_id"), F.coalesce(whole == F.col("doc_id"), F.lit(False)).alias("kept"))
