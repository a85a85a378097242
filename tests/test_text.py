import pytest
from pyspark.sql import functions as F

from lexispark.functions import stemming as st
from lexispark.functions import text as tx
from lexispark.functions.web import listing_links, normalise_url, parse_article


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("x")).first()["x"]


def test_tokens(spark):
    text = "A\u0301rbol GRÜN ca’l rock'n'roll well-known 1984 q 7up ß"
    df = spark.createDataFrame([(text,)], "t string").select(tx.tokens(F.col("t")).alias("x"))
    assert df.first()["x"] == ["árbol", "grün", "ca'l", "rock'n'roll", "well", "known", "7up", "ss"]
    own = lambda t, **o: one(spark, tx.tokens(F.col("t"), **o), t=t)
    assert own("well-known twenty‐one 3-d d-3 x-y", hyphens=True) == ["well-known", "twenty-one", "x-y"]
    assert own("1984 7 42a a1 ab12 007", numbers=True) == ["1984", "ab12", "007"] and own("a bc def", minimum_letters=3) == ["def"] and own("a 1", minimum_letters=1) == ["a"]
    assert own("", numbers=True) == [] and one(spark, tx.tokens(F.col("t")), t=None) is None
    assert one(spark, tx.word_count(F.col("t")), t="Sechs Wörter_mit 3 Zeichen, à peu près") == 7


def test_tokens_equal_the_table_function(spark):
    from lexispark.functions import udtf

    texts = ["don't Don’t 'tis rock'n'roll 'a' b' c'1 1'd a1'b", "E\u0301te\u0301 ΣΟΦΟΣ ﬁnal ẞ STRASSE İstanbul", "x y zz 12 3a a3 ab3 ٣٤ab", "", "क्षि नमस्ते"]
    udtf.register(spark)
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    mine = {r.i: r.x for r in df.select("i", tx.tokens(F.col("t")).alias("x")).collect()}
    rows = spark.sql("SELECT i, collect_list(struct(k.pos, k.token)) AS x FROM {df} d, LATERAL text_tokens(d.t, 2) k GROUP BY i", df=df).collect()
    theirs = {r.i: [k.token for k in sorted(r.x)] for r in rows}
    assert {i: x for i, x in mine.items() if x} == theirs
    assert one(spark, tx.casefold(F.col("t")), t="ẞΣς ﬀ µ É") == "ẞΣς ﬀ µ É".casefold()


def test_normal_forms(spark):
    assert one(spark, tx.normalise_text(F.col("t")), t="  u \t v\r\nw \n\r\n \t\n  e\u0301 z\r") == "u v w\n\né z"
    assert one(spark, tx.normalise_sentence(F.col("t")), t=" e\u0301 \n\t b\u00a0c ") == "é b c"
    url = lambda u: one(spark, normalise_url(F.col("u")), u=u)
    assert url("HTTP://Me:pw@News.Site.NET:80//x///y/?gclid=1&z=&a=%7Eq+r&a=%2A#top") == "http://news.site.net/x/y?a=%2A&a=~q+r&z="
    assert url("https://site.net:8443") == "https://site.net:8443/" and url("https://site.net/?UTM_campaign=1") == "https://site.net/"
    assert [url(u) for u in ("ftp://x.y/z", "mailto:a@b.c", "https:///x", "", None)] == [None] * 5
    time = lambda t, **o: one(spark, tx.parse_timestamp(F.col("t"), **o), t=t)
    assert time("2021-07-08T09:10:11+00:00") == "2021-07-08T09:10:11Z" and time("2021-07-08T09:10:11.5-03:30") == "2021-07-08T09:10:11.500000-03:30" and time("2021-07-08T09:10:11.000Z") == "2021-07-08T09:10:11Z"
    assert time("") is None and time(None) is None
    for wrong, more in (("2021-07-08T09:10:11", {}), ("2021-13-08T09:10:11Z", {}), ("2021-02-30T09:10:11Z", {}), ("2021-07-08T09:61:11Z", {}), ("", {"required": True})):
        with pytest.raises(Exception):
            time(wrong, **more)


def test_digests(spark):
    import hashlib

    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert one(spark, tx.match_id(F.col("a"), F.col("b")), a="x", b="y") == sha("x\ny")
    df = spark.createDataFrame([("é", None, 3)], "b string, c string, a int")
    assert df.select(tx.json_digest("b", "c", "a")).first()[0] == sha('{"a":3,"b":"é","c":null}')
    rows = spark.createDataFrame([("", "r1"), (None, "r2"), ("p", "r3")], "published_at string, retrieved_at string")
    assert [r[0] for r in rows.select(tx.scan_order()).collect()] == ["r1", "r2", "p"]


def test_shingles_and_jaccard(spark):
    a = lambda t, b: sorted(one(spark, tx.word_shingles(F.col("t"), F.col("b")), t=t, b=b))
    assert a("A b", "c d") == ["a b c", "b c d"] and a("a", "") == ["a"] and a("", "") == []
    df = spark.createDataFrame([([], []), (["a", "b"], ["b", "c"])], "a array<string>, b array<string>")
    assert [r[0] for r in df.select(tx.jaccard(F.col("a"), F.col("b"))).collect()] == [1.0, pytest.approx(1 / 3)]


def test_suffix_stemmers(spark):
    rules = [st.Rule("ing", "", 3, 0, ("thing",)), st.Rule("s", "", 2, 1), st.Rule("ings", "", 3, 0)]
    assert st.validate_rules(rules) == [] and len(st.validate_rules([st.Rule("S"), st.Rule("x"), st.Rule("x"), st.Rule("y", minimum=0)])) == 3
    words = ["walkings", "walking", "thing", "things", "as", "ring"]
    df = spark.createDataFrame([(w,) for w in words], "t string")
    assert [r[0] for r in df.select(st.suffix_stem(F.col("t"), rules)).collect()] == ["walk", "walk", "thing", "thing", "as", "ring"]
    assert [r[0] for r in df.select(st.repeated_suffix_stem(F.col("t"), rules)).collect()] == ["walk", "walk", "thing", "thing", "as", "ring"]
    with pytest.raises(ValueError):
        st.repeated_suffix_stem(F.col("t"), [st.Rule("s", "es")])
    # an exception holds for the word as it came, also after a step
    kept = [st.Rule("s", "", 2, 0), st.Rule("ing", "", 1, 0, ("rings",))]
    assert [r[0] for r in spark.createDataFrame([("rings",), ("sings",)], "t string").select(st.repeated_suffix_stem(F.col("t"), kept)).collect()] == ["ring", "s"]
    guarded = st.guarded_stemmer(rules, frozenset({"s"}), frozenset({"cat"}))
    assert [r[0] for r in spark.createDataFrame([("cats",), ("dogs",)], "t string").select(guarded("t")).collect()] == ["cat", "dogs"]


@pytest.mark.parametrize("word,stem", [("caresses", "caress"), ("ponies", "poni"), ("ties", "tie"), ("running", "run"), ("hopping", "hop"), ("hoping", "hope"), ("generously", "generous"), ("nationalization", "nation"), ("dying", "die"), ("skies", "sky"), ("happily", "happili"), ("agreed", "agre"), ("consignment", "consign"), ("knightly", "knight")])
def test_english_stemmer(word, stem):
    assert st.english_stem(word) == stem


# the sample vocabulary published with the stemmer, by stem (fixed values)
SAMPLE = {
    "consign": "consign consigned consigning consignment", "consist": "consist consisted consistency consistent consistently consisting consists", "consol": "consolation consolations console consoled consoles consoling consolingly consols", "consolatori": "consolatory",
    "consolid": "consolidate consolidated consolidating", "conson": "consonant", "consort": "consort consorted consorting", "conspicu": "conspicuous conspicuously", "conspiraci": "conspiracy", "conspir": "conspirator conspirators conspire conspired conspiring",
    "constabl": "constable constables", "constanc": "constance constancy", "constant": "constant", "knack": "knack knacks", "knackeri": "knackeries", "knag": "knag", "knave": "knave knaves", "knavish": "knavish", "knead": "kneaded kneading", "knee": "knee knees",
    "kneel": "kneel kneeled kneeling kneels", "knell": "knell", "knelt": "knelt", "knew": "knew", "knick": "knick", "knif": "knif", "knife": "knife", "knight": "knight knightly knights", "knit": "knit knits knitted knitting", "knive": "knives", "knob": "knob knobs",
    "knock": "knock knocked knocking knocks", "knocker": "knocker knockers", "knopp": "knopp", "knot": "knot knots",
}


def test_english_stemmer_on_its_sample():
    for stem, words in SAMPLE.items():
        assert {st.english_stem(w) for w in words.split()} == {stem}


def test_two_kinds_of_pages():
    meta = '<meta name="author" content="Ann, Bob ,"><meta name="published_at" content="2021-01-01"><meta property="article:section" content="City"><meta property="og:title" content=" Shared ">'
    page = f"{meta}<p>no</p><article><h1>A <i>title</i></h1><p>One</p><li>no</li><p>two <b>bold</b> three</p></article><p>out</p>"
    got = parse_article(page)
    assert got == {"title": "A title", "body": "One\n\ntwo\n\nbold\n\nthree", "authors": ["Ann", "Bob"], "published_at": "2021-01-01", "updated_at": None, "section": None, "error": None}
    assert parse_article(None)["error"] == "missing title" and parse_article("<article><h1>t</h1></article>")["error"] == "missing body"
    page = f'{meta}<div class="dipr-post"><p>no</p><div class="x article-body"><p>One <b>bold</b></p><li>two</li><p> </p></div><p>out</p></div>'
    got = parse_article(page, "dipr_html_v1")
    assert got == {"title": "Shared", "body": "One bold\n\ntwo", "authors": ["Ann, Bob ,"], "published_at": None, "updated_at": None, "section": "City", "error": None}
    with pytest.raises(ValueError):
        parse_article(page, "none")


def test_references_cut_of_their_semicolon_are_read_as_the_reference_parser_reads_them():
    ends = {"&amp": "&", "&amp;&amp": "&&", "&quot": '"', "&lt": "<", "&am": "&am", "&": "&", "&amp;amp": "&amp"}
    for cut, read in ends.items():
        got = parse_article(f"<article><h1>Ores{cut}</h1><p>Fish{cut}</p></article>")
        assert (got["title"], got["body"]) == (f"Ores{read}", f"Fish{read}")


def test_listings():
    html = '<div class="wide press-release-list"><p>x<br><a href="/post/2/?x=1#y">b</a></p><a href="HTTPS://Other.ORG/post/1">a</a><a href="/page/4">d</a></div><a href="/post/3">c</a>'
    assert listing_links(html, "https://ex.org/") == ["https://ex.org/post/2", "https://other.org/post/1"]
    assert listing_links(html, "https://ex.org/", "/", None) == ["https://ex.org/page/4", "https://ex.org/post/2", "https://ex.org/post/3", "https://other.org/post/1"]
    assert listing_links(None, "https://ex.org/") == []


def test_local_seed(spark):
    import hashlib

    assert one(spark, tx.local_seed(F.col("t")), t="1:m:2:3") == int.from_bytes(hashlib.sha256(b"1:m:2:3").digest()[:4], "little")


def test_extent_of_texts_sums_what_a_table_function_makes_before_it_is_sorted(spark):
    from lexispark.functions import udtf
    from lexispark.plans.corpus import shingle_table

    rows = [(1, "b"), (1, "é"), (2, None), (2, "z"), (3, None), (None, "q"), (1, "a"), (None, "Q")]
    got = {tuple(r) for r in udtf.text_extent(spark.createDataFrame(rows, "k long, t string").repartition(3), "k", "t").collect()}
    assert got == {(1, 3, "a", "é"), (2, 2, "z", "z"), (3, 1, None, None), (None, 2, "Q", "q")}
    plan = shingle_table(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().split("== Initial")[0].splitlines()
    at = next(i for i, line in enumerate(plan) if "EvalPythonUDTF" in line)
    summed = max(i for i, line in enumerate(plan[:at]) if "MapInArrow" in line)
    assert not any("Sort" in line for line in plan[summed:at])
