import io
import json
import os
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from lexispark.sources.archive import read_archive, verify_archive, write_archive

CONTENT = {"a/one.txt": b"one" * 5000, "two.txt": b"", "b/three.bin": bytes(range(256)) * 40, "ä/vier.txt": "vier".encode()}


def a_zip(path, method=zipfile.ZIP_DEFLATED):
    with zipfile.ZipFile(path, "w", method) as z:
        z.mkdir("a")
        for n, c in CONTENT.items():
            z.writestr(n, c)
    return str(path)


def a_tar(path, mode):
    with tarfile.open(path, mode) as t:
        for n, c in CONTENT.items():
            info = tarfile.TarInfo(n)
            info.size = len(c)
            t.addfile(info, io.BytesIO(c))
    return str(path)


def as_dict(df):
    return {r.entry: bytes(r.content) for r in df.collect()}


def test_entries_of_all_kinds(spark, tmp_path):
    for path in (a_zip(tmp_path / "x.zip"), a_zip(tmp_path / "stored.zip", zipfile.ZIP_STORED), a_tar(tmp_path / "y.tar", "w"), a_tar(tmp_path / "z.tar.gz", "w:gz"), f"file://{tmp_path}/x.zip"):
        for size in (1, 64 << 20):
            assert as_dict(read_archive(spark, path, partition_bytes=size)) == CONTENT
        assert as_dict(read_archive(spark, path, entries=["two.txt", "a/one.txt"])) == {k: CONTENT[k] for k in ("two.txt", "a/one.txt")}
    assert read_archive(spark, str(tmp_path / "x.zip"), partition_bytes=1).rdd.getNumPartitions() == 4
    assert read_archive(spark, str(tmp_path)).count() == 16


def test_what_is_wrong_is_an_error(spark, tmp_path):
    path = a_zip(tmp_path / "x.zip", zipfile.ZIP_STORED)
    with pytest.raises(Exception, match="no entry none.txt"):
        read_archive(spark, path, entries=["none.txt"]).collect()
    with pytest.raises(Exception, match="no entry none.txt"):
        read_archive(spark, a_tar(tmp_path / "z.tar.gz", "w:gz"), entries=["none.txt"]).collect()
    with pytest.raises(Exception, match="SHA-256 differs"):
        read_archive(spark, path, sha256="0" * 64).collect()
    raw = bytearray(open(path, "rb").read())
    at = raw.index(b"oneone")
    raw[at] ^= 1
    open(path, "wb").write(raw)
    with pytest.raises(Exception, match="CRC-32 of a/one.txt differs"):
        read_archive(spark, path).collect()
    with pytest.raises(Exception, match="not from hdfs"):
        read_archive(spark, "hdfs://host/x.zip").collect()


def test_a_folder_is_put_in_place_whole_or_not_at_all(spark, tmp_path):
    path = f"{tmp_path}/out"
    rows = spark.range(200).select(F.format_string("%d.txt", "id").alias("entry"), F.repeat(F.lit("é"), F.col("id").cast("int")).alias("content")).repartition(5, "entry")
    write_archive(rows, path)
    assert verify_archive(path) == [] and as_dict(read_archive(spark, path)) == {f"{i}.txt": ("é" * i).encode() for i in range(200)}
    parts = json.load(open(f"{path}/manifest.json"))["parts"]
    assert sum(p["rows"] for p in parts) == 200
    write_archive(rows, f"{tmp_path}/again")
    assert [p["sha256"] for p in json.load(open(f"{tmp_path}/again/manifest.json"))["parts"]] == [p["sha256"] for p in parts]
    before = set(os.listdir(tmp_path))
    bad = rows.withColumn("content", F.when(F.col("entry") == "77.txt", F.raise_error(F.lit("halt")).cast("string")).otherwise(F.col("content")))
    for target, mode in ((path, True), (f"{tmp_path}/new", False)):
        with pytest.raises(Exception, match="halt"):
            write_archive(bad, target, overwrite=mode)
    assert set(os.listdir(tmp_path)) == before and verify_archive(path) == []
    with pytest.raises(Exception):
        write_archive(rows, path)
    write_archive(rows.limit(3), path, overwrite=True)
    assert read_archive(spark, path).count() == 3
    with open(f"{path}/{json.load(open(f'{path}/manifest.json'))['parts'][0]['name']}", "ab") as f:
        f.write(b"x")
    assert verify_archive(path) == [json.load(open(f"{path}/manifest.json"))["parts"][0]["name"]]
