import json

import pytest
from pyspark.sql import functions as F

from lexispark.operators import conditions, policy, records
from lexispark.sources import files


def test_json_lines(spark, tmp_path):
    df = spark.createDataFrame([("b", None), ("a", "é"), ("c", "")], "y string, x string")
    for k in (1, 3):
        files.write_jsonl(df.repartition(k), f"file://{tmp_path}/j{k}")
    text = ["".join(p.read_text() for p in sorted((tmp_path / f"j{k}").glob("part*"))) for k in (1, 3)]
    assert text[0] == text[1] == '{"x":"","y":"c"}\n{"x":"é","y":"a"}\n{"x":null,"y":"b"}\n'
    back = files.read_jsonl(spark, f"file://{tmp_path}/j1", "x string, y string")
    assert sorted((r.y, r.x) for r in back.collect()) == [("a", "é"), ("b", None), ("c", "")]
    (tmp_path / "bad").write_text('{"x": 1}\n\n{]\n')
    with pytest.raises(Exception):
        files.read_jsonl(spark, f"file://{tmp_path}/bad", "x string").collect()


def test_aligned_lines_over_many_splits(spark, tmp_path):
    left = [f"line {i} " + "x" * (i % 50) for i in range(4000)]
    (tmp_path / "l").write_text("\ufeff" + "\n".join(left) + "\n")
    (tmp_path / "r").write_text("\n".join(str(i) for i in range(4000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        got = files.read_aligned(spark, f"file://{tmp_path}/l", f"file://{tmp_path}/r").orderBy("row").collect()
        assert [(r.row, r.left, r.right) for r in got] == [(i, t, str(i)) for i, t in enumerate(left)]
        (tmp_path / "s").write_text("one\ntwo")
        with pytest.raises(Exception):
            files.read_aligned(spark, f"file://{tmp_path}/l", f"file://{tmp_path}/s").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_tables_snapshots_and_exports(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("URL\tdomain\nu1\td1\n")
    assert [tuple(r) for r in files.read_table(spark, f"file://{tmp_path}/t.tsv", ["domain", "URL"]).collect()] == [("d1", "u1")]
    with pytest.raises(ValueError):
        files.read_table(spark, f"file://{tmp_path}/t.tsv", ["URL", "topic"])
    (tmp_path / "b.bin").write_bytes(b"abc")
    import hashlib
    import zlib

    sha, crc = hashlib.sha256(b"abc").hexdigest(), zlib.crc32(b"abc")
    assert files.read_snapshots(spark, f"file://{tmp_path}/b.bin", sha, crc, 3).select("size", "sha256", "crc32").collect() == [(3, sha, crc)]
    for wrong in ({"pinned": "0" * 64}, {"crc32": 1}, {"size": 4}):
        with pytest.raises(Exception):
            files.read_snapshots(spark, f"file://{tmp_path}/b.bin", **wrong).collect()
    docs = spark.createDataFrame([(1, "en", "token", 10, [0, 2]), (2, "fr", "token", 10, [])], "doc_id long, lang string, condition string, k int, keywords array<long>")
    files.write_export(docs, f"file://{tmp_path}/e")
    assert sorted((r.doc_id, r.lang, r.k, list(r.keywords)) for r in spark.read.parquet(f"file://{tmp_path}/e").collect()) == [(1, "en", 10, [0, 2]), (2, "fr", 10, [])]
    meta = files.write_artifacts(f"file://{tmp_path}/a", documents=docs, vocabulary=spark.range(3))
    assert {r.name: r.rows for r in meta.collect()} == {"documents": 2, "vocabulary": 3} and files.verify_artifacts(spark, f"file://{tmp_path}/a") == []
    spark.range(1, 4).write.mode("overwrite").parquet(f"file://{tmp_path}/a/vocabulary")
    assert files.verify_artifacts(spark, f"file://{tmp_path}/a") == ["vocabulary"]
    assert files.table_digest(docs) == files.table_digest(docs.repartition(5))


def test_manifest(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"sources": [{"source_id": "a", "n": 1}, {"source_id": "b", "n": 2}]}, indent=1))
    assert sorted((r.source_id, r.n) for r in files.read_manifest(spark, f"file://{tmp_path}/m.json").collect()) == [("a", 1), ("b", 2)]
    assert files.read_manifest(spark, f"file://{tmp_path}/m.json", schema="source_id string, n int, note string").where("note is null").count() == 2
    (tmp_path / "m.json").write_text(json.dumps({"sources": [{"source_id": "a"}, {"source_id": "a"}]}))
    with pytest.raises(ValueError):
        files.read_manifest(spark, f"file://{tmp_path}/m.json")


def test_records_are_refused_with_a_reason(spark):
    schema = "source_id string, language string, canonical_url string, title string, body string, retrieved_at string, raw_sha256 string"
    good = ("s", "en", "http://x.org/a", "T", "b c", "2022-03-04T05:06:07Z", None)
    sources = spark.createDataFrame([("s", "approved", "approved", "full_text", "none", ["en"]), ("t", "candidate", "approved", "full_text", "none", ["en"])], "source_id string, status string, permission_status string, storage_mode string, redistribution_mode string, languages array<string>")
    run = lambda row: records.normalise_records(spark.createDataFrame([row], schema), sources).collect()
    made = run(good)[0]
    assert made.document_type == "article" and made.authors == [] and made.section is None and made.rights.storage_mode == "full_text"
    for place, value in ((0, "t"), (0, "unknown"), (1, "lus"), (2, "ftp://x"), (3, " "), (4, ""), (5, "2022-03-04"), (5, None), (6, "xyz")):
        with pytest.raises(Exception):
            run(tuple(value if i == place else v for i, v in enumerate(good)))
    whole = records.with_duplicates(records.normalise_records(spark.createDataFrame([good, (*good[:2], "http://x.org/b", "t", "B C", *good[5:])], schema), sources))
    assert whole.where("duplicate.status = 'exact'").count() == 1
    assert whole.select(F.size(policy.record_errors(whole, require_duplicate=True))).distinct().collect() == [(0,)]
    assert whole.drop("title").select(policy.record_errors(whole.drop("title"))).first()[0] == ["missing:title"]


def _write(root, **named):
    for name, payload in named.items():
        at = root / name.replace("__", "/")
        at.parent.mkdir(exist_ok=True)
        at.with_suffix(".json").write_text(json.dumps(payload))


def test_conditions_from_files(spark, tmp_path):
    import hashlib

    review = {"status": "approved", "scope": "test", "reviewed_by": "r", "reviewed_at": "2022-01-01"}
    plain = {"config_version": "1.0.0", "unicode_form": "NFC", "indexed_fields": ["title", "body"], "minimum_letter_count": 2, "minimum_document_frequency": 1, "maximum_document_frequency_ratio": 1.0}
    rule = lambda s, p, e=(): {"suffix": s, "replacement": "", "minimum_stem_letter_count": 2, "priority": p, "exceptions": list(e)}
    words = {"partition": "auxiliary", "language": "lus", "tokens": ["kalo"]}
    stem = {"config_version": "1.0.0", "stopword_condition": "configs/stop.json", "required_scope": "test", "stemmer_specifications": {"en": "lists/en_stem.json", "lus": "lists/lus_stem.json"}}
    policy1 = {"policy_version": "1.0.0", "algorithm": "repeated_suffix_with_attestation", "exception_scope": "original_and_intermediate_per_rule", "wordlist": "lists/words.json", "guarded_suffixes": ["in"]}
    policy2 = {"policy_version": "2.0.0", "algorithm": "reviewer_clarified_repeated_suffix", "exception_scope": "current_form_per_rule", "guarded_suffixes": [], "clarification_record": "lists/said.json", "clarification_source_sha256": "abc"}
    _write(
        tmp_path, configs__plain=plain, configs__stop={"config_version": "1.0.0", "tokenisation_config": "configs/plain.json", "required_scope": "test", "stopword_lists": {"en": "lists/en.json", "lus": "lists/lus.json"}},
        lists__en=review | {"language": "en", "entries": [{"token": "the", "decision": "exclude_from_index"}, {"token": "keep", "decision": "retain"}]}, lists__lus=review | {"language": "lus", "entries": []},
        lists__en_stem=review | {"language": "en", "algorithm": "snowball_english", "rules": []}, lists__lus_stem=review | {"language": "lus", "algorithm": "suffix_strip_v1", "rules": [rule("te", 0), rule("in", 1)]},
        lists__words=words, lists__said={"source_sha256": "abc"}, configs__stem=stem,
    )
    policy1["wordlist_sha256"] = hashlib.sha256((tmp_path / "lists/words.json").read_bytes()).hexdigest()
    _write(tmp_path, configs__p1=policy1, configs__p2=policy2, configs__stem1=stem | {"mizo_execution_policy": "configs/p1.json"}, configs__stem2=stem | {"mizo_execution_policy": "configs/p2.json"})
    docs = spark.createDataFrame([(1, "en", "The cats", "keep running"), (2, "lus", "kaloin palointe", "talotete"), (3, "fr", "the cats", None)], "doc_id long, lang string, title string, body string")
    at = lambda name: f"file://{tmp_path}/configs/{name}.json"
    lexicon = spark.createDataFrame([("kalo",)], "token string")

    def run(name):
        condition, found = conditions.load_condition(spark, at(name))
        out = {r.doc_id: (r.tokens, r.removed, r.changed) for r in condition.documents(docs, lexicon if found else None).collect()}
        assert out[3] == (["the", "cats"], 0, 0)
        return out

    assert run("plain")[1] == (["the", "cats", "keep", "running"], 0, 0) and run("stop")[1] == (["cats", "keep", "running"], 1, 0)
    assert run("stem")[1] == (["cat", "keep", "run"], 1, 2) and run("stem")[2][0] == ["kalo", "paloin", "talote"]
    assert run("stem1")[2][0] == ["kalo", "paloin", "talo"] and run("stem2")[2][0] == ["kalo", "palo", "talo"]
    condition, _ = conditions.load_condition(spark, at("stem"))
    assert [(r.idx, r.token) for r in condition.vocabulary(condition.documents(docs)).orderBy("idx").collect()][:2] == [(0, "cat"), (1, "cats")]
    faults = [
        ("lists__en", review | {"language": "en", "entries": [{"token": "two words", "decision": "exclude_from_index"}]}, "stop"), ("lists__en", review | {"language": "en", "status": "draft", "entries": []}, "stop"),
        ("lists__en", review | {"language": "en", "entries": [{"token": "a" * 3, "decision": "pending"}]}, "stop"), ("lists__en_stem", review | {"language": "en", "algorithm": "other", "rules": []}, "stem"),
        ("lists__words", words | {"tokens": ["other"]}, "stem1"), ("lists__said", {"source_sha256": "new"}, "stem2"), ("configs__plain", plain | {"unicode_form": "NFD"}, "plain"), ("configs__plain", plain | {"indexed_fields": ["title", "title"]}, "plain"),
    ]
    for name, payload, of in faults:
        old = (tmp_path / name.replace("__", "/")).with_suffix(".json").read_text()
        _write(tmp_path, **{name: payload})
        with pytest.raises(ValueError):
            conditions.load_condition(spark, at(of))
        (tmp_path / name.replace("__", "/")).with_suffix(".json").write_text(old)


def test_arriving_records(spark, tmp_path):
    from lexispark.streaming.ingest import first_records

    at = tmp_path / "in"
    spark.createDataFrame([("2024-01-01 00:00:00", "A b"), ("2024-01-01 01:00:00", "a B"), ("2024-01-01 02:00:00", "c")], "ts string, text string").selectExpr("cast(ts as timestamp) ts", "text").write.parquet(f"file://{at}")
    stream = first_records(spark.readStream.schema("ts timestamp, text string").parquet(f"file://{at}"))
    stream.writeStream.format("memory").queryName("arrived").option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start().awaitTermination(120)
    assert spark.table("arrived").select(F.lower("text").alias("t")).distinct().count() == 2 and spark.table("arrived").count() == 2
