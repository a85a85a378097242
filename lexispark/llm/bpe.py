"""BPE encoding by backtracking over longest matches, decoding by an offset table.

Each word is scanned once by an Aho-Corasick automaton over all tokens, which gives the longest token that starts at
each place. The encoder walks from left to right, takes the longest token that is *compatible* with the one before it
(the merges of the two, side by side, would leave both as they are), falls back to the next shorter token, and steps
back when none fits; a place once given up is never tried again, so the walk is linear in the word's length. The
result is exactly that of applying the merges in order of rank. The compatibility of two tokens is found by undoing
merges along their common border and is kept in a table.

Decoding gathers the bytes of the tokens from one block of bytes with a table of offsets.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.llm.common import small_batches

# White_Space of Unicode, as the library's pattern engine has it (fixed values)
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
# code points that this pattern engine, of a later Unicode version, calls letters or numbers and the library does not (fixed values)
NEWER = (
    "\\u0558\\u058b-\\u058c\\u088f\\u0c5c\\u0cdc\\u208f\\u209d-\\u209f\\ua7ce-\\ua7cf\\ua7d2\\ua7d4\\ua7dd\\ua7e2\\ua7f1\\uab6c-\\uab6d"
    "\\U000107bb-\\U000107bf\\U00010940-\\U00010959\\U00010ec5-\\U00010ec7\\U00010ed9-\\U00010eee\\U00011b0a\\U00011db0-\\U00011ddb"
    "\\U00011de0-\\U00011de9\\U00011df1\\U0001246f\\U00012475-\\U0001247f\\U00012550-\\U00012686\\U00016ea0-\\U00016eb8\\U00016ebb-\\U00016ed3"
    "\\U00016ff2-\\U00016ff6\\U000187f8-\\U000187ff\\U00018cd6-\\U00018cda\\U00018d09-\\U00018d20\\U00018d80-\\U00018df2\\U00018e00-\\U00019191"
    "\\U000191a0-\\U000191d2\\U0001b123-\\U0001b128\\U0001b168\\U0001d6a6\\U0001df1f-\\U0001df24\\U0001df2b-\\U0001df81\\U0001df90-\\U0001df96"
    "\\U0001dfcd-\\U0001dfff\\U0001e6c0-\\U0001e6de\\U0001e6e0-\\U0001e6e2\\U0001e6e4-\\U0001e6e5\\U0001e6e7-\\U0001e6ed\\U0001e6f0-\\U0001e6f4"
    "\\U0001e6fe-\\U0001e6ff\\U0002b73a-\\U0002b73f\\U0002b81e\\U0002cea2-\\U0002cead\\U000323b0-\\U00033479\\U0003d000-\\U0003fc3f"
)
# capitals that later Unicode versions paired with small letters: single ones, then runs (first, last, distance) (fixed values)
NEWER_CAPITALS = {0x1C89: 0x1C8A, 0xA7CB: 0x0264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x019B}
NEWER_CAPITAL_RUNS = ((0x10D50, 0x10D65, 0x20), (0x16EA0, 0x16EB8, 0x1B))
CACHE_WORDS = 400_000
_END = 0x1000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> list[str]:
    """The printable letter of each byte in byte-level vocabularies: printable bytes stand for themselves, others follow from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [], 256
    for b in range(256):
        if b in own:
            out.append(chr(b))
        else:
            out.append(chr(extra))
            extra += 1
    return out


def _lowering() -> tuple[dict[int, int], regex.Pattern]:
    """The small letters of capitals that this Python may not know, and a pattern that finds such a capital."""
    table = dict(NEWER_CAPITALS)
    for first, last, off in NEWER_CAPITAL_RUNS:
        table |= {c: c + off for c in range(first, last + 1)}
    return table, regex.compile("[" + "".join(map(chr, table)) + "]")


class BPE:
    """A tokenizer read from a JSON file of the tokenizers library, of the kind with word ends and byte letters."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in model["merges"]]
        rank = {a + b if not (self.suffix and a.endswith(self.suffix)) else None: i for i, (a, b) in enumerate(merges)}
        base = [t for t in vocab if t not in rank]
        # own numbers: letters first, then merges by rank; a larger number is a later merge
        self.number = {t: i for i, t in enumerate(base)}
        self.number |= {t: len(base) + i for t, i in rank.items()}
        n = len(self.number)
        self.ids = np.zeros(n, np.uint32)
        for t, i in self.number.items():
            self.ids[i] = vocab[t]
        self.pair = {(self.number[a], self.number[b]): self.number[a + b] for a, b in merges}
        self.halves: list[tuple[int, int] | None] = [None] * n
        for (a, b), c in self.pair.items():
            self.halves[c] = (a, b)
        # a token as a string in which the letter at a word's end is one letter of its own
        spell = {t: self._spelled(t) for t in self.number}
        self.length = [0] * n
        self.shorter = [-1] * n
        by = {s: self.number[t] for t, s in spell.items()}
        self.scan = ahocorasick.Automaton()
        for s, i in by.items():
            self.length[i] = len(s)
            self.shorter[i] = next((by[s[:k]] for k in range(len(s) - 1, 0, -1) if s[:k] in by), -1)
            self.scan.add_word(s, i)
        self.scan.make_automaton()
        self.fits: dict[tuple[int, int], bool] = {}
        self.known: dict[str, bytes] = {}
        self.letters = _byte_letters()
        self.specials = {x["content"]: int(x["id"]) for x in spec.get("added_tokens", [])}
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        self.words = regex.compile(f"'s|'t|'re|'ve|'m|'ll|'d|(?:(?![{NEWER}])\\p{{L}})+|(?![{NEWER}])\\p{{N}}|(?:[{NEWER}]|[^{SPACE}\\p{{L}}\\p{{N}}])+")
        self.plain_words = regex.compile(f"'s|'t|'re|'ve|'m|'ll|'d|\\p{{L}}+|\\p{{N}}|[^{SPACE}\\p{{L}}\\p{{N}}]+")
        self.newer = regex.compile(f"[{NEWER}]")
        self.small, self.capital = _lowering()
        text = {i: t for t, i in vocab.items()} | {i: t for t, i in self.specials.items()}
        size = max(text, default=-1) + 1
        # no decoder is named in the file, so decoding joins the tokens' own spellings by blanks: each carries one
        pieces = [(text.get(i, "") + " ").encode() for i in range(size)]
        self.offset = np.zeros(size + 1, np.int64)
        np.cumsum([len(p) for p in pieces], out=self.offset[1:])
        self.block = np.frombuffer(b"".join(pieces), np.uint8)

    def _spelled(self, token: str) -> str:
        if self.suffix and token.endswith(self.suffix) and len(token) > len(self.suffix):
            body = token[: -len(self.suffix)]
            return body[:-1] + chr(ord(body[-1]) + _END)
        return token

    def compatible(self, a: int, b: int) -> bool:
        """Whether the merges, applied to the letters of ``a`` then ``b``, leave exactly these two tokens."""
        known = self.fits.get((a, b))
        if known is not None:
            return known
        left, right, until = a, b, len(self.ids)
        ok = True
        while True:
            joined = self.pair.get((left, right))
            if joined is not None and joined < until:
                ok = False  # at that moment the two stand side by side, and this merge comes before what they grow into
                break
            # undo the later of the two merges; of equal numbers the right one, for merges are applied from the left
            for side in ("left", "right") if left > right else ("right", "left"):
                if side == "left" and self.halves[left]:
                    until, left = left, self.halves[left][1]
                    break
                if side == "right" and self.halves[right]:
                    until, right = right + 1, self.halves[right][0]
                    break
            else:
                break
        if len(self.fits) > 2_000_000:
            self.fits.clear()
        self.fits[a, b] = ok
        return ok

    def encode_word(self, word: str) -> list[int]:
        """Own numbers of the tokens of one word (a match of the pattern), exact."""
        s = "".join([self.letters[x] for x in word.encode("utf-8")])
        if not s:
            return []
        if self.suffix:
            s = s[:-1] + chr(ord(s[-1]) + _END)
        n = len(s)
        longest = [-1] * n
        length = self.length
        for end, tok in self.scan.iter(s):  # ends ascend, so the last one written for a start is the longest
            longest[end + 1 - length[tok]] = tok
        open_ = bytearray(b"\x01" * (n + 1))
        out: list[int] = []
        at, tok = 0, longest[0]
        while at < n:
            end = at + length[tok]
            if open_[end] and (not out or self.compatible(out[-1], tok)):
                out.append(tok)
                at = end
                tok = longest[at] if at < n else -1
                continue
            tok = self.shorter[tok]
            while tok < 0:  # nothing that starts here fits: give this place up, shorten the token before
                open_[at] = 0
                last = out.pop()
                at -= length[last]
                tok = self.shorter[last]
        return out

    def _word_bytes(self, word: str) -> bytes:
        got = self.known.get(word)
        if got is None:
            got = self.ids[self.encode_word(word)].astype("<u4").tobytes()
            if len(self.known) >= CACHE_WORDS:
                self.known.clear()
            self.known[word] = got
        return got

    def encode(self, text: str) -> bytes:
        """Token ids as little-endian unsigned 32-bit integers."""
        parts = self.special_split.split(text) if self.special_split else [text]
        out: list[bytes] = []
        for i, part in enumerate(parts):
            if i % 2:
                out.append(self.specials[part].to_bytes(4, "little"))
            elif part:
                part = unicodedata.normalize("NFC", part)
                # letter by letter: a capital sigma has one small form, whatever follows
                part = part.lower() if "Σ" not in part else "".join(c.lower() for c in part)
                if self.capital.search(part):
                    part = part.translate(self.small)
                known, make = self.known, self._word_bytes
                out += [known.get(w) or make(w) for w in (self.words if self.newer.search(part) else self.plain_words).findall(part)]
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the decoded text."""
        if not len(ids):
            return b""
        start = self.offset[ids]
        size = self.offset[ids.astype(np.int64) + 1] - start
        ends = np.cumsum(size)
        place = np.repeat(start - (ends - size), size)
        place += np.arange(ends[-1])
        return self.block[place].tobytes()[:-1]


_loaded: dict[str, BPE] = {}


def tokenizer(path: str) -> BPE:
    """One per worker process."""
    if path not in _loaded:
        _loaded[path] = BPE(path)
    return _loaded[path]


def encode_decode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, with_text: bool = False) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256, and on request ids (array<int>) and decoded (string).

    Null and empty texts have no tokens and decode to the empty text. Very long texts are encoded whole. Repeated
    rows give repeated results; an empty table gives none. Other columns are ignored. One pass, no shuffle.
    """
    spark = docs.sparkSession
    small_batches(spark)
    path = path or default_path()
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids + ", decoded string" * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for b in batches:
            n, a, d, ids, texts = [], [], [], [], []
            for text in b.column(1).to_pylist():
                raw = t.encode(text or "")
                x = np.frombuffer(raw, "<u4")
                back = t.decode(x)
                n.append(len(x))
                a.append(hashlib.sha256(raw).hexdigest())
                d.append(hashlib.sha256(back).hexdigest())
                if with_ids:
                    ids.append(x.astype(np.int32))
                if with_text:
                    texts.append(back.decode("utf-8"))
            cols = [b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())]
            cols += [pa.array(ids, pa.list_(pa.int32()))] * with_ids + [pa.array(texts, pa.string())] * with_text
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids + ["decoded"] * with_text)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
