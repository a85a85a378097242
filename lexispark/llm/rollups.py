"""Token counts kept by deltas: additive totals by source, language and tokenizer version.

A batch is a table of signed rows: inserts (+), deletes (-) and revisions (the old count -, the new one +). Its rows
are summed by key before anything is shuffled, added to the totals of the last commit, and written as a new state;
then one commit record, named by the commit's number alone, makes that state the current one. A batch with a record changes nothing, and
a batch that died before its record leaves no trace, so batches may be sent again at will. A record is written aside and put in
its place by a rename that never replaces: of two writers that make the same commit number one fails.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.llm.common import shared_dir, small_batches, temporary, written

KEYS = ["source", "lang", "tokenizer"]
_SHAPE = "source string, lang string, tokenizer string, n_docs long, n_tokens long"
_RUNS = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [t or b"" for t in b.column(3).cast(pa.binary()).to_pylist()]
        counts = [pa.array([f(t) for t in texts], kind) for f, kind in ((lambda t: len(t.split()), pa.int64()), (lambda t: len(_RUNS.findall(t)), pa.int64()), (xxhash.xxh3_128_digest, pa.binary()))]
        yield pa.RecordBatch.from_arrays([*b.columns[:3], *counts], names=["doc_id", "source", "lang", "blank_words", "run_words", "digest"])


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, source, lang, blank_words (runs without ASCII white space), run_words (runs of ASCII letters, digits and other letters), digest of the text. Null texts are empty."""
    small_batches(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(_counted, "doc_id long, source string, lang string, blank_words long, run_words long, digest binary")


class TokenRollup:
    """Totals in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _commits(self) -> list[tuple[int, str, str]]:
        """(number, batch, state) of every commit, oldest first."""
        at = self._path("commits")
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(at):
            return []
        out = []
        for s in fs.listStatus(at):
            name = s.getPath().getName()
            if name.isdigit():
                with_state = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream := fs.open(s.getPath()), "UTF-8")
                stream.close()
                out.append((int(name), *with_state.split("~")))
        return sorted(out)

    def _publish(self, number: int, batch: str, state: str) -> None:
        """Put the record in its place; raises if another writer's stands there."""
        conf = self.spark._jsc.hadoopConfiguration()
        aside, place = self._path(f"states/{state}.record"), self._path(f"commits/{number:09d}")
        fs = aside.getFileSystem(conf)
        fs.mkdirs(self._path("commits"))
        out = fs.create(aside, False)
        out.write(bytearray(f"{batch}~{state}".encode()))
        out.close()
        none = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.getFileSystem(conf).getUri(), conf).rename(aside, place, none)
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" not in str(e.java_exception):
                raise
            raise RuntimeError(f"another writer has made commit {number} meanwhile") from e

    def totals(self) -> DataFrame:
        """Keys with their documents and tokens; keys whose totals have come back to nothing are not kept."""
        done = self._commits()
        if not done:
            return self.spark.createDataFrame([], _SHAPE)
        return self.spark.read.schema(_SHAPE).parquet(f"{self.path}/states/{done[-1][2]}")

    def apply(self, batch: str, deltas: DataFrame) -> bool:
        """Add a batch of rows (source, lang, tokenizer, sign, n_tokens); False if it was committed before.

        Null keys are keys of their own. ``sign`` is 1 or -1; rows with a null sign or count add nothing, and a batch without
        rows is committed too. One writer at a time; one that races finds its commit number taken and raises, having changed nothing.
        """
        if not re.fullmatch(r"[\w.-]+", batch):
            raise ValueError(f"a batch is named by letters, digits, dots and hyphens: {batch!r}")
        done = self._commits()
        if any(b == batch for _, b, _ in done):
            return False
        signed = deltas.where("sign is not null and n_tokens is not null").groupBy(*KEYS).agg(F.sum(F.col("sign").cast("long")).alias("n_docs"), F.sum(F.col("sign") * F.col("n_tokens")).cast("long").alias("n_tokens"))
        new = self.totals().unionByName(signed).groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs <> 0 or n_tokens <> 0")
        state = uuid.uuid4().hex
        new.write.parquet(f"{self.path}/states/{state}")
        self._publish(len(done) + 1, batch, state)
        return True


def signed(rows: DataFrame, tokenizer: str, count: str, sign: int) -> DataFrame:
    return rows.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), F.lit(sign).alias("sign"), F.col(count).cast("long").alias("n_tokens"))


def maintained(docs: DataFrame) -> DataFrame:
    """A corpus's life in six batches, one of them sent twice: two tokenizer versions come in, later copies of a text go, the
    first version's counts are revised to hold an end mark each, and the copies come back with the counts then in force.
    Returns the totals over all rows.

    Null texts have no words; a null source or language is a key of its own; rows without an identifier and repeated rows count
    as often as they occur (of a text without any identifier no row goes). An empty table gives no rows. Columns other than the four named are ignored.
    """
    spark = docs.sparkSession
    rows = written(token_counts(docs), "counts")
    kept = written(rows.groupBy("digest").agg(F.min("doc_id").alias("first")), "firsts")  # written, so that the skew join may split a hot digest
    copies = written(rows.join(kept, "digest").where("doc_id <> first"), "copies")
    left = rows.join(kept, "digest").where("first is null or doc_id is null or doc_id = first")
    more = lambda x: x.withColumn("more", F.col("blank_words") + 1)
    roll = TokenRollup(spark, f"{shared_dir(spark)}/lexispark/rollup-{uuid.uuid4().hex}")
    roll.apply("in-blank-1", signed(rows, "blank-1", "blank_words", 1))
    temporary(spark, roll.path)
    roll.apply("in-runs-1", signed(rows, "runs-1", "run_words", 1))
    gone = signed(copies, "blank-1", "blank_words", -1).union(signed(copies, "runs-1", "run_words", -1))
    roll.apply("copies-out", gone)
    roll.apply("copies-out", gone)
    roll.apply("blank-revised", signed(left, "blank-1", "blank_words", -1).union(signed(more(left), "blank-1", "more", 1)))
    roll.apply("copies-in", signed(more(copies), "blank-1", "more", 1).union(signed(copies, "runs-1", "run_words", 1)))
    return roll.totals()
