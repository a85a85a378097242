import hashlib
import random
import re

from lexispark.llm.secrets import Automaton, Formats, Tree, digests, infer, rule_spans, secret_scan

SCHEMA = "doc_id long, text string, spans string, found int"
ASSIGN = re.compile(r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")


def brute(text):
    """The rules one by one over the whole text."""
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    out += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]
    return sorted(out, key=lambda s: (s[1], ["assign", "access", "hex"].index(s[0])))


def test_rules_against_brute_force():
    r = random.Random(2)
    parts = ["password", "PassWd", "secret", "toKen", "api_key", "APIKEY", "toſen", "toKen", "=", ":", " ", "  ", "'", '"', "AKIA", "AKIAAKIA", "0123456789ABCDEF", "deadbeefdeadbeef", "0a1b2c3d", "ff", "x", ".", "-", "word ", "é", "😀", "\n", "==", "a/b+c_d"]
    for _ in range(6000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 14)))
        assert [s[:3] for s in rule_spans(text)] == brute(text), text


def test_automata_keep_what_is_fixed_and_loop_what_repeats():
    r = random.Random(4)
    key = lambda: "AKIA" + "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16))
    values = sorted({key() for _ in range(600)})
    learned = infer(values)
    assert len(learned["states"]) <= 8
    a = Automaton(learned["states"])
    assert all(a.likelihood(key()) > a.likelihood("XKIA" + key()[4:]) + 5 for _ in range(50))
    # probabilities of all values of a small alphabet sum to one at most, and nearly so
    small = Automaton(infer(sorted({"".join(r.choice("ab") for _ in range(r.randint(1, 6))) for _ in range(300)}))["states"])
    total, level = 0.0, [""]
    for _ in range(13):
        import math

        total += sum(math.exp(small.likelihood(w)) for w in level)
        level = [w + c for w in level for c in "ab"]
    assert 0.9 < total <= 1.0 + 1e-9


def test_folding_keeps_every_count():
    r = random.Random(6)
    values = ["".join(r.choice("abc") for _ in range(r.randint(0, 9))) for _ in range(400)]
    tree = Tree(values)
    kept = tree.merge()
    assert sum(tree.ends[s] for s in kept) == len(values) and sum(sum(tree.arcs[s].values()) for s in kept) == sum(map(len, values))
    for v in values:
        at = 0
        for c in v:
            at = tree.next[at][c]
        assert tree.ends[at] and at in kept


def planted():
    r = random.Random(9)
    hexes = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    words = lambda n: " ".join("".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 9))) for _ in range(n))
    long = lambda: "".join(r.choice("etaoinshrdlu") for _ in range(r.randint(16, 22)))
    rows, hidden = [], {}
    for i in range(400):
        kind = i % 4
        body = {0: f'token = "{hexes(40)}"', 1: f"password={hexes(18)}", 2: long(), 3: "plain"}[kind]
        rows.append((i, f"{words(8)} {body} {words(8)}"))
    for i in range(400, 440):
        key, before = hexes(18), words(5)
        rows.append((i, f"{before} {key}, {words(5)}"))
        hidden[i] = f"{len(before) + 1}:{len(before) + 19}"
    clean = ["2024-01-15T10:30:00.000Z", "4111111111111111", "internationalisation", "/usr/local/share/doc/readme.txt", "550e8400-e29b-41d4-a716-446655440000", "www.example.org/some/page.html"]
    rows += [(500 + i, f"{words(4)} {c} {words(4)}") for i, c in enumerate(clean)]
    return rows, hidden


def test_formats_find_what_no_rule_names(spark):
    rows, hidden = planted()
    got = {r.doc_id: r for r in digests(secret_scan(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA))).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        base = brute(t)
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        r = got[i]
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(b[0] == k for b in base) for k in ("assign", "access", "hex"))
        assert set(filter(None, joined.split(","))) <= set(r.spans.split(","))
        if i not in hidden:
            assert r.spans == joined, t
    found = sum(got[i].spans.split(":", 1)[-1] == place for i, place in hidden.items())
    assert found >= 0.9 * len(hidden)


def test_edges(spark):
    rows = [(1, None), (2, ""), (None, "secret: abcdef1"), (3, "token=abcdef"), (3, "token=abcdef"), (4, "w " * 200_000 + "token=abcdefg " + "0123456789abcdef" * 8000)]
    got = digests(secret_scan(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA))).collect()
    assert len(got) == len(rows)
    spans = sorted((r.doc_id or 0, r.spans) for r in got)
    assert spans == [(0, "assign:0:15"), (1, ""), (2, ""), (3, "assign:0:12"), (3, "assign:0:12"), (4, "assign:400000:400013,hex:400014:528014")]
    assert digests(secret_scan(spark.createDataFrame([], SCHEMA))).collect() == []
    assert Formats({}).judge("0123456789abcdef0123") is None
