"""Secret scans: spans of fixed rules label credentials, grammar inference learns their formats, and all other candidates are scored by them.

The rules give labelled credentials of three kinds. For each kind, and for ordinary long words as a background, a prefix tree of
sampled values is turned into a probabilistic automaton: states whose frequencies of ending and of every next character are statistically alike
(Hoeffding's bound, down to the last state both have seen often) are merged, so what repeats becomes a loop and what is fixed stays a chain.
A candidate is a long run of key characters outside all rule spans. It is a secret of the kind whose automaton gives it the largest
likelihood if that, against the background, outweighs the odds of ordinary words, and if it is as likely for each character as the labelled ones are.

A text is read once: rule spans and candidates are written, models are learned in one bounded group a kind, and the written candidates are scored.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispark.llm.common import hash63, small_batches, written

# kinds and their rules (fixed values)
KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
_ACCESS, _HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]+")
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 6, 20, 24

_KEYS = ("passw", "secret", "token", "apikey", "api_key")
_RUN = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
_PIECE = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9+/_.-]{14,}[A-Za-z0-9])")
#: shortest candidate; both patterns above have it
LEAST_CANDIDATE = 16
#: values that an automaton is learned from: at most so many of each kind, picked by hash, none longer than this
SAMPLE, LONGEST = 2048, 256
BACKGROUND = "ordinary"
SYMBOLS = 69  # letters, digits, six signs, the end
ALPHA, SHARE, QUANTILE, SMOOTH = 0.05, 1e-4, 0.01, 1.0

_SPAN = "array<struct<kind: string, start: int, end: int, value: string>>"


def rule_spans(text: str, runs: list[re.Match] | None = None) -> list[tuple[str, int, int, str]]:
    """kind, start, end and value (what is secret) of the rules' matches, by start, then kind. Places are code points, ends exclusive."""
    out = []
    low = text.lower()
    if any(k in low for k in _KEYS):
        out = [("assign", m.start(), m.end(), m[1]) for m in _ASSIGN.finditer(text) if len(m[1]) >= LEAST_VALUE]
    # keys of both other kinds lie within a long run
    for run in runs if runs is not None else _RUN.finditer(text):
        for kind, rule, least in (("access", _ACCESS, LEAST_ACCESS), ("hex", _HEX, LEAST_HEX)):
            out += [(kind, run.start() + m.start(), run.start() + m.end(), m[0]) for m in rule.finditer(run[0]) if len(m[0]) >= least]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def candidates(runs: list[re.Match], known: list[tuple[str, int, int, str]]) -> list[tuple[int, int, str]]:
    """Long runs of key characters, without signs at their ends, that touch no known span."""
    out, at, reach = [], 0, -1
    for run in runs:
        for m in _PIECE.finditer(run[0]):
            start, end = run.start() + m.start(), run.start() + m.end()
            while at < len(known) and known[at][1] < end:
                reach = max(reach, known[at][2])
                at += 1
            if reach <= start:
                out.append((start, end, m[0]))
    return out


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())]))
    for b in batches:
        found, rest = [], []
        for t in b.column(1).to_pylist():
            runs = list(_RUN.finditer(t or ""))
            known = rule_spans(t or "", runs)
            found.append([{"kind": k, "start": s, "end": e, "value": v} for k, s, e, v in known])
            rest.append([{"kind": BACKGROUND, "start": s, "end": e, "value": v} for s, e, v in candidates(runs, known)])
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, kinds), pa.array(rest, kinds)], names=["doc_id", "found", "rest"])


class Tree:
    """A prefix tree of values that becomes an automaton as its states merge."""

    def __init__(self, values: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.arcs: list[dict[str, int]] = [{}]
        self.ends = [0]
        self.count = [0]
        for v in values:
            at = 0
            self.count[0] += 1
            for c in v:
                self.arcs[at][c] = self.arcs[at].get(c, 0) + 1
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.arcs.append({})
                    self.ends.append(0)
                    self.count.append(0)
                at = self.next[at][c]
                self.count[at] += 1
            self.ends[at] += 1

    def alike(self, a: int, b: int, alpha: float = ALPHA) -> bool:
        """Whether two states, and all that follow both, differ by no more than chance allows."""
        wide = math.sqrt(0.5 * math.log(2 / alpha))
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n, m = self.count[a], self.count[b]
            bound = wide * (1 / math.sqrt(n) + 1 / math.sqrt(m)) if n and m else 2.0
            if bound >= 1:
                continue  # no difference of shares could tell
            if abs(self.ends[a] / n - self.ends[b] / m) > bound:
                return False
            for c in self.arcs[a].keys() | self.arcs[b].keys():
                if abs(self.arcs[a].get(c, 0) / n - self.arcs[b].get(c, 0) / m) > bound:
                    return False
            if a != b:
                todo += [(self.next[a][c], self.next[b][c]) for c in self.next[a].keys() & self.next[b].keys()]
        return True

    def fold(self, into: int, state: int) -> None:
        """The tree below a state joins another state and what follows it."""
        todo = [(into, state)]
        while todo:
            into, state = todo.pop()
            self.count[into] += self.count[state]
            self.ends[into] += self.ends[state]
            for c, n in self.arcs[state].items():
                self.arcs[into][c] = self.arcs[into].get(c, 0) + n
                if c in self.next[into]:
                    todo.append((self.next[into][c], self.next[state][c]))
                else:
                    self.next[into][c] = self.next[state][c]

    def merge(self) -> list[int]:
        """Merge until every state that is reached has its own statistics: the states that stay, the first one first."""
        kept = [0]
        while True:
            fringe = [(self.count[t], r, c, t) for r in kept for c, t in self.next[r].items() if t not in kept]
            if not fringe:
                return kept
            _, parent, c, state = max(fringe, key=lambda f: (f[0], -f[1], f[2]))
            # what comes after a state most often goes on as it does: the parent is asked first
            to = next((r for r in [parent, *kept] if self.alike(r, state)), None)
            if to is None:
                kept.append(state)
            else:
                self.next[parent][c] = to
                self.fold(to, state)


class Automaton:
    """States with probabilities of the next character or the end; what a state has not seen leads to a state of overall frequencies."""

    def __init__(self, states: list[dict]):
        total: dict[str, float] = {}
        for s in states:
            for c, (_, n) in s["next"].items():
                total[c] = total.get(c, 0) + n
            total[""] = total.get("", 0) + s["end"]
        every = sum(total.values())
        unseen = math.log(SMOOTH / SYMBOLS / (every + SMOOTH))
        overall = {c: (n + SMOOTH / SYMBOLS) / (every + SMOOTH) for c, n in total.items()}
        free = len(states)
        self.steps: list[dict[str, tuple[int, float]]] = []
        for s in states:
            n = s["end"] + sum(x for _, x in s["next"].values())
            step = {c: (free, math.log(SMOOTH * p / (n + SMOOTH))) for c, p in overall.items()}
            for c, (to, x) in [*s["next"].items(), ("", (free, s["end"]))]:
                if x:
                    step[c] = (to, math.log((x + SMOOTH * overall[c]) / (n + SMOOTH)))
            self.steps.append(step)
        self.steps.append({c: (free, math.log(p)) for c, p in overall.items()})
        self.lost = (free, unseen)

    def likelihood(self, value: str) -> float:
        """Logarithm of the probability of the whole value, end included."""
        at, sum_ = 0, 0.0
        for c in value:
            at, p = self.steps[at].get(c, self.lost)
            sum_ += p
        return sum_ + self.steps[at].get("", self.lost)[1]


def infer(values: list[str]) -> dict:
    """An automaton as plain data: its states with their arcs, and the least likelihood for each character that labelled values have.

    The least is a quantile over the values that were left out while an automaton of the others scored them, half by half.
    """
    learn = lambda v: _plain(Tree(v))
    halves = values[::2], values[1::2]
    held = []
    if min(map(len, halves)) >= 10:
        for a, b in (halves, halves[::-1]):
            model = Automaton(learn(a))
            held += [model.likelihood(v) / (len(v) + 1) for v in b]
    held.sort()
    return {"states": learn(values), "least": held[int(QUANTILE * len(held))] if held else None}


def _plain(tree: Tree) -> list[dict]:
    kept = tree.merge()
    place = {s: i for i, s in enumerate(kept)}
    return [{"end": tree.ends[s], "next": {c: (place[t], tree.arcs[s][c]) for c, t in sorted(tree.next[s].items())}} for s in kept]


def _learn(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"kind": [pdf["kind"].iat[0]], "model": [json.dumps(infer(sorted(pdf["value"])))]})


class Formats:
    """The learned automata of all kinds."""

    def __init__(self, models: dict[str, str]):
        plain = {k: json.loads(m) for k, m in models.items()}
        self.kinds = {k: (Automaton(plain[k]["states"]), plain[k]["least"]) for k in KINDS if k in plain}
        self.ordinary = Automaton(plain[BACKGROUND]["states"]) if BACKGROUND in plain else None

    def judge(self, value: str) -> tuple[str, float] | None:
        """Kind and probability of a candidate's best format; None if it is an ordinary run of characters."""
        if not self.kinds:
            return None
        # plain numbers and words are ordinary even where the corpus has none so long
        other = [-math.log(SYMBOLS) * (len(value) + 1)]
        if self.ordinary is not None:
            other.append(self.ordinary.likelihood(value))
        if value.isdigit():
            other.append(math.log(0.01) - math.log(10) * len(value))
        elif value.isalpha():
            other.append(math.log(0.01) - math.log(26) * len(value))
        against = max(other)
        kind, best = max(((k, a.likelihood(value)) for k, (a, _) in self.kinds.items()), key=lambda x: x[1])
        odds = best - against + math.log(SHARE)
        least = self.kinds[kind][1]
        if odds <= 0 or least is None or best / (len(value) + 1) < least:
            return None
        return kind, 1 / (1 + math.exp(-odds))


def learn_formats(scanned: DataFrame, sample: int = SAMPLE) -> Formats:
    """Automata from the distinct labelled values (and the ordinary candidates) of a scanned table; one bounded group a kind."""
    every = scanned.select(F.explode(F.concat("found", "rest")).alias("s")).select("s.kind", "s.value").where(F.length("value") <= LONGEST).distinct()
    near = hash63(F.col("value"))
    rows = None
    for kind in (*KINDS, BACKGROUND):  # an ordered limit each: no window over all values of a kind
        one = every.where(F.col("kind") == kind).orderBy(near, "value").limit(sample)
        rows = one if rows is None else rows.unionByName(one)
    return Formats({r.kind: r.model for r in rows.groupBy("kind").applyInPandas(_learn, "kind string, model string").collect()})  # four rows


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """One row per input row: doc_id, spans (kind, start, end, value, base, score), by start, then kind.

    ``base``: found by a rule (score 1); the others are candidates that a learned format explains (score: its probability). A null text is an empty one;
    very long texts are scanned whole; repeated rows and rows without a doc_id are scanned as they are. A kind that fewer than twenty distinct values label
    adds nothing of its own. An empty table gives no rows. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scanned = written(src.mapInArrow(_scanned, f"doc_id long, found {_SPAN}, rest {_SPAN}"), "secrets")
    formats = learn_formats(scanned, sample)

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for found, rest in zip(b["found"], b["rest"], strict=True):
                spans = [(s["kind"], s["start"], s["end"], s["value"], True, 1.0) for s in found]
                for s in rest:
                    if (got := formats.judge(s["value"])) is not None:
                        spans.append((got[0], s["start"], s["end"], s["value"], False, got[1]))
                out.append([dict(zip(("kind", "start", "end", "value", "base", "score"), x, strict=True)) for x in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))])
            yield pd.DataFrame({"doc_id": b["doc_id"], "spans": out})

    # most texts have no candidate: those go without Python
    some = F.size("rest") > 0
    base = F.transform("found", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), F.lit(True).alias("base"), F.lit(1.0).alias("score")))
    ids = scanned.where(some).withColumn("doc_id", F.col("doc_id").cast("string"))  # a column of long numbers with nulls would pass as doubles
    judged = ids.mapInPandas(scored, "doc_id string, spans array<struct<kind: string, start: int, end: int, value: string, base: boolean, score: double>>")
    return scanned.where(~some).select("doc_id", base.alias("spans")).unionByName(judged.withColumn("doc_id", F.col("doc_id").cast("long")))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(scan: DataFrame) -> DataFrame:
    """Counts and digests of a scan: doc_id, n_assign, n_access, n_hex (by rule), base_sha256, spans (text), n_inferred, score (the largest)."""
    of = lambda kind: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long")
    return scan.select(
        "doc_id", *[of(k).alias(f"n_{k}") for k in KINDS], F.sha2(_listed(F.filter("spans", lambda s: s["base"])), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: ~s["base"])).cast("long").alias("n_inferred"), F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)).alias("score"),
    )
