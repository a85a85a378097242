import itertools
import random

from pyspark.sql import functions as F

from lexispark.functions import stemming as st
from lexispark.operators import incidence as inc
from lexispark.plans import audits
from lexispark.plans.corpus import RULES, guarded_stems


def test_guarded_stems_know_every_word(spark, tmp_path):
    frequent = ["".join(w) for w in itertools.product("bcdfghjklmnpqrtvwxz", repeat=3)][:5200]
    rows = [(1, "en", " ".join(frequent)), (2, "en", " ".join(frequent)), (3, "en", "eae eaes zzozes zzoz zzolys zzoly")]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.token: r.stem for r in guarded_stems(spark, str(tmp_path)).collect()}
    assert got["eaes"] == "eae" and got["zzozes"] == "zzozes" and got["zzolys"] == "zzo"
    assert len(got) == 5206


def test_guarded_stems_as_with_a_lexicon(spark):
    words = ["".join(w) for n in (4, 5, 6) for w in itertools.product("aes", repeat=n)] + ["houses", "house", "hous", "things", "thing"]
    lexicon = frozenset(words[::3])
    guarded = frozenset({"s", "e"})
    df = spark.createDataFrame([(w,) for w in words], "token string")
    known = F.filter(st.guarded_candidates(RULES, guarded, letters_only=True)(F.col("token")), lambda c: c.isin(*lexicon))
    both = df.select("token", known.alias("known")).select(st.guarded_stemmer(RULES, guarded, letters_only=True)("token", "known").alias("a"), st.guarded_stemmer(RULES, guarded, lexicon, letters_only=True)("token").alias("b"))
    assert all(r.a == r.b for r in both.collect())


def test_repeated_stems_go_on_until_nothing_changes(spark):
    df = spark.createDataFrame([("xyz" + "s" * 9,), ("a",), ("",), (None,)], "token string")
    assert [r[0] for r in df.select(st.repeated_suffix_stem(F.col("token"), RULES)).collect()] == ["xyz", "a", "", None]


def test_leading_stems_are_counted_among_their_contenders_only(spark, monkeypatch):
    rnd = random.Random(3)
    words = [a + b for a in ("walk", "talk", "call", "tree", "stone", "river", "lamp", "cord", "field", "moss") for b in ("", "s", "ed", "ing")]
    rows = [(i, rnd.choice(["en", "fr", None]), sorted({words[min(int(rnd.expovariate(0.12)), 39)] for _ in range(rnd.randrange(9))})) for i in range(400)]
    tok = spark.createDataFrame(rows, "doc_id long, lang string, tokens array<string>")
    stem = lambda t: t.withColumn("tokens", F.array_distinct(F.transform("tokens", lambda x: st.suffix_stem(x, RULES))))
    first = lambda t: {tuple(r) for lang in ("en", "fr") for r in inc.document_frequency(stem(t)).where(F.col("lang") == lang).orderBy(F.desc("df"), "token").limit(3).collect()}
    counted = inc.document_frequency(tok).withColumn("stem", st.suffix_stem(F.col("token"), RULES))
    few = inc.stem_contenders(counted, 3)
    assert few.count() < counted.count()
    kept = inc.restricted(tok, few)
    assert first(kept) == first(tok) and kept.count() == len(rows)
    monkeypatch.setattr(inc, "FEW", 0)
    by_rows = inc.restricted(tok, few).select("doc_id", "lang", F.sort_array("tokens"))
    assert sorted(map(str, by_rows.collect())) == sorted(map(str, kept.select("doc_id", "lang", F.sort_array("tokens")).collect()))


def test_conditions_are_not_written_as_whole_texts(spark, monkeypatch):
    """What is written for three conditions holds the words that can be keywords, not three times all of them."""
    sizes = {}
    whole = inc.written
    seen = lambda df, tag: sizes.setdefault(tag, []).append(out := whole(df, tag)) or out
    monkeypatch.setattr(inc, "written", seen)
    monkeypatch.setattr(audits, "written", seen)
    audits.condition_metrics(spark, "/root/testdata/sf0.001")
    held = lambda tag: sizes[tag][0].agg(F.sum(F.size("tokens"))).first()[0]
    assert held("conditions") < held("tokens")
