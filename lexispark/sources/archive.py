"""Archives as a data source: entries of ZIP and tar files dealt over partitions and checked, and a sink that puts a whole folder in place.

A ZIP file's directory, or a plain tar file's headers, say where each entry lies: an archive larger than a partition is cut into runs of entries, each read
by its own ranges alone; smaller ones go whole to a task, which reads their directory itself. A compressed tar file can only be read from its start, so one task streams it.
Every entry's size, and in a ZIP file its CRC-32, must be those that the archive states. Places are local or shared paths (or ``file:`` addresses).
"""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import struct
import tarfile
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "archive string, entry string, size long, crc32 long, content binary"
PARTITION_BYTES = 64 << 20
ENDINGS = (".zip", ".tar", ".tar.gz", ".tgz")
MANIFEST = "manifest.json"
# parts of a ZIP file's local header: its mark, and where the lengths of name and extra field stand (fixed values)
_LOCAL, _LOCAL_SIZE, _LENGTHS_AT = b"PK\x03\x04", 30, 26
_STORED, _DEFLATED = 0, 8


def local_path(address: str) -> str:
    """The path of a local or shared folder; another scheme is an error, for Python workers cannot read there."""
    parts = urlparse(address)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"archives are read from local or shared folders, not from {parts.scheme}:")
    return unquote(parts.path) if parts.scheme else address


def _archives(path: str) -> list[str]:
    if os.path.isdir(path):
        return sorted(os.path.join(path, f) for f in os.listdir(path) if f.endswith(ENDINGS))
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    return [path]


def _file_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def directory(path: str) -> list[tuple] | None:
    """name, offset, stored size, size, CRC-32 (None in a tar file) and method of each entry; None for a compressed tar file."""
    if path.endswith(".zip"):
        with zipfile.ZipFile(path) as z:
            return [(i.filename, i.header_offset, i.compress_size, i.file_size, i.CRC, i.compress_type) for i in z.infolist() if not i.is_dir()]
    if path.endswith(".tar"):
        with tarfile.open(path, "r:") as t:
            return [(i.name, i.offset_data, i.size, i.size, None, _STORED) for i in t if i.isfile()]
    return None


def read_entry(f, path: str, entry: tuple) -> tuple:
    """archive, entry, size, CRC-32 and content of an entry, read by its range; what is not as stated is an error."""
    name, offset, stored, size, crc, method = entry
    if crc is not None:
        f.seek(offset)
        head = f.read(_LOCAL_SIZE)
        if head[:4] != _LOCAL:
            raise ValueError(f"{path}: no header where {name} should begin")
        offset += _LOCAL_SIZE + sum(struct.unpack_from("<HH", head, _LENGTHS_AT))
    f.seek(offset)
    content = f.read(stored)
    if method == _DEFLATED:
        content = zlib.decompress(content, -zlib.MAX_WBITS)
    elif method != _STORED:
        raise ValueError(f"{path}: {name} is compressed by method {method}, which is not known")
    return _checked(path, name, content, size, crc)


def _checked(path: str, name: str, content: bytes, size: int, crc: int | None) -> tuple:
    if len(content) != size:
        raise ValueError(f"{path}: {name} has {len(content)} bytes, not {size}")
    own = zlib.crc32(content)
    if crc is not None and own != crc:
        raise ValueError(f"{path}: the CRC-32 of {name} differs")
    return path, name, size, own, content


class _Some(InputPartition):
    def __init__(self, path: str, entries: list[tuple] | None):
        self.path, self.entries = path, entries


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = local_path(options["path"])
        self.wanted = set(json.loads(options["entries"])) if "entries" in options else None
        self.pinned = options.get("sha256")
        self.most = int(options.get("partition_bytes", PARTITION_BYTES))

    def partitions(self) -> list[_Some]:
        out: list[_Some] = []
        for path in _archives(self.path):
            if self.pinned and _file_digest(path) != self.pinned:
                raise ValueError(f"{path}: the SHA-256 differs from the pinned one")
            listed = directory(path) if self.wanted is not None or os.path.getsize(path) > self.most else None
            if listed is None:
                out.append(_Some(path, None))
                continue
            if self.wanted is not None and (absent := self.wanted - {e[0] for e in listed}):
                raise ValueError(f"{path}: no entry {sorted(absent)[0]}")
            run, held = [], 0
            for e in sorted(listed, key=lambda e: e[1]):
                if self.wanted is None or e[0] in self.wanted:
                    if run and held + e[2] > self.most:
                        out.append(_Some(path, run))
                        run, held = [], 0
                    run.append(e)
                    held += e[2]
            if run:
                out.append(_Some(path, run))
        return out

    def read(self, partition: _Some) -> Iterator[tuple]:
        path = partition.path
        entries = partition.entries if partition.entries is not None else directory(path)
        if entries is not None:
            with open(path, "rb") as f:
                for e in entries:
                    yield read_entry(f, path, e)
            return
        seen = set()
        with tarfile.open(path, "r|gz") as t:
            for i in t:
                if i.isfile() and (self.wanted is None or i.name in self.wanted):
                    seen.add(i.name)
                    yield _checked(path, i.name, t.extractfile(i).read(), i.size, None)
        if self.wanted is not None and (absent := self.wanted - seen):
            raise ValueError(f"{path}: no entry {sorted(absent)[0]}")


class _Part(WriterCommitMessage):
    def __init__(self, name: str, rows: int, size: int, sha256: str):
        self.name, self.rows, self.size, self.sha256 = name, rows, size, sha256


class ArchiveWriter(DataSourceWriter):
    """One ZIP file a task in a folder of its own beside the target; the commit writes the manifest and renames that folder in one step."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = local_path(options["path"]).rstrip("/"), overwrite
        self.own = f"{self.path}.{uuid.uuid4().hex}"
        if os.path.exists(self.path) and not overwrite:
            raise FileExistsError(self.path)

    def write(self, rows: Iterator) -> _Part:
        from pyspark import TaskContext

        task = TaskContext.get()
        name = f"part-{task.partitionId():05d}.zip"
        os.makedirs(self.own, exist_ok=True)
        draft = f"{self.own}/.{name}.{task.taskAttemptId()}"
        n = 0
        with zipfile.ZipFile(draft, "w", zipfile.ZIP_DEFLATED) as z:
            for r in rows:
                # one date for all: equal rows give equal bytes
                z.writestr(zipfile.ZipInfo(r.entry, (1980, 1, 1, 0, 0, 0)), bytes(r.content), zipfile.ZIP_DEFLATED)
                n += 1
        part = _Part(name, n, os.path.getsize(draft), _file_digest(draft))
        os.replace(draft, f"{self.own}/{name}")
        return part

    def commit(self, messages: list) -> None:
        os.makedirs(self.own, exist_ok=True)
        parts = sorted((m for m in messages if m is not None and m.rows), key=lambda m: m.name)
        for name in set(os.listdir(self.own)) - {p.name for p in parts}:
            os.remove(f"{self.own}/{name}")
        with open(f"{self.own}/{MANIFEST}", "w", encoding="utf-8") as f:
            json.dump({"parts": [{"name": p.name, "rows": p.rows, "bytes": p.size, "sha256": p.sha256} for p in parts]}, f, indent=1)
        old = f"{self.own}.old"
        if self.overwrite and os.path.exists(self.path):
            os.rename(self.path, old)
        os.rename(self.own, self.path)
        shutil.rmtree(old, ignore_errors=True)

    def abort(self, messages: list) -> None:
        shutil.rmtree(self.own, ignore_errors=True)


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(dict(self.options), overwrite)


def read_archive(spark: SparkSession, path: str, entries: list[str] | None = None, sha256: str | None = None, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """archive, entry, size, crc32, content of an archive's entries, or of all archives in a folder.

    ``entries``: those to be read, all of which every archive must have; ``sha256``: the digest of the archive. What is damaged, absent or of another digest is an error.
    """
    spark.dataSource.register(ArchiveSource)
    r = spark.read.format("archive").option("partition_bytes", str(partition_bytes))
    if entries is not None:
        r = r.option("entries", json.dumps(entries))
    return (r if sha256 is None else r.option("sha256", sha256)).load(path)


def write_archive(rows: DataFrame, path: str, overwrite: bool = False) -> None:
    """``rows`` (entry, content) as ZIP files in a folder, with a manifest of their rows, sizes and digests; a write that fails leaves nothing behind."""
    rows.sparkSession.dataSource.register(ArchiveSource)
    rows.select("entry", rows["content"].cast("binary").alias("content")).write.format("archive").mode("overwrite" if overwrite else "append").save(path)


def verify_archive(path: str) -> list[str]:
    """Parts of a written folder that are not what its manifest says; files that it does not name, too."""
    at = local_path(path)
    with open(f"{at}/{MANIFEST}", encoding="utf-8") as f:
        parts = {p["name"]: p for p in json.load(f)["parts"]}
    have = set(os.listdir(at)) - {MANIFEST}
    wrong = {n for n in have & parts.keys() if os.path.getsize(f"{at}/{n}") != parts[n]["bytes"] or _file_digest(f"{at}/{n}") != parts[n]["sha256"]}
    return sorted(wrong | (have ^ parts.keys()))
