import hashlib
import random
import re

from lexispark.llm.infill import digests, fill_in_middle

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")
SCHEMA = "doc_id long, text string, n string, form string, marked string"


def plain(doc_id, text):
    """doc_id, n, form, prefix_chars, middle_chars, output, text: the definition, unit by unit."""
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    if doc_id is None:
        return (doc_id, n, "plain", None, None, text, text)
    digest = hashlib.sha256(f"1:{doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return (doc_id, n, "plain", None, None, text, text)
    lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:lo]), "".join(units[lo:hi]), "".join(units[hi:])
    form = "spm" if h[3] % 100 < 20 else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return (doc_id, n, form, len(p), len(m), out, text)


def check(spark, rows):
    got = digests(fill_in_middle(spark.createDataFrame([(*r, "a", "b", "c") for r in rows], SCHEMA))).collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = sorted(((*w[:5], sha(w[5]), sha(w[6])) for w in (plain(*r) for r in rows)), key=repr)
    assert sorted((tuple(r) for r in got), key=repr) == want
    return got


def test_against_the_definition(spark):
    r = random.Random(5)
    pieces = ["word", "Z", "ä", " ", "\n", "\r\n", "é", "日本", "😀", "<", ">", "<P", "S>", "M", "\x1f", "\x1e", "\x1e0", "\x1e1", "\x1f1", "0", "1", "$0", "\\", "\t", ".", "́", "ſ", "\x00x"[1:]]
    rows = [(i, "".join(r.choice(pieces) for _ in range(r.randint(0, 40)))) for i in range(900)]
    rows += [(i, "".join(r.choice(["\x1f", "\x1e", "1", "0"]) for _ in range(12))) for i in range(900, 1000)]
    got = check(spark, rows)
    assert {g.form for g in got} == {"plain", "psm", "spm"}


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "a <P> b"), (4, "x<S>"), (5, "<M>"), (None, "some text"), (7, "one"), (7, "one"), (7, "other text"), (-9, "negative ids have their digits and sign")]
    rows += [(i, t) for i in range(10, 30) for t in ("<", "<P", "S><", "word " * 50_000, "é" * 100_000)]
    check(spark, rows)
    assert digests(fill_in_middle(spark.createDataFrame([], SCHEMA))).collect() == []
