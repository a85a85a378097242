"""Sharding by balanced label propagation, in DataFrame operations only.

Documents with equal texts are linked, and each starts with the label of a shard dealt by a hash. A group of copies
larger than a shard is cut into full shards and one rest. Groups (and rests) above a quarter of a shard, four a
shard at most, are placed first, the largest first, each where most of its documents are among the shards with room for it.
In every round each other group asks for the label most frequent in it, a refused one for its next; a shard admits what fits beside the
groups admitted before, for all documents of a group move together and their old places are vacated. Buckets that do not fit are passed over, not waited for.
When no round admits anything more, the groups left are dealt along the room left, in the order of a hash; those across a
border, fewer than there are shards, go whole where they fit and are cut into as few parts as they can be only where
none does. Documents without a link then fill every shard exactly to its quota, so the counts differ by one at most.

What reaches the driver is a table of shards by hash buckets and a few groups for each shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexispark.llm.common import hash63, width, with_rank, written

BUCKETS, ROUNDS = 256, 8


def _at(values: list[int], place: Column) -> Column:
    return F.element_at(F.array(*[F.lit(int(v)).cast("long") for v in values]), (place + 1).cast("int"))


def cut_up(copies: int, room: list[int], labels: dict[int, int], quota: int) -> list[tuple[int, int]]:
    """Parts (size, shard) of a group; ``room`` is used up. Whole quotas first, the rest in one shard if it fits in any."""
    parts = []

    def put(n: int, s: int) -> None:
        room[s] -= n
        parts.append((n, s))

    while copies > quota:
        s = max(range(len(room)), key=lambda s: (room[s], labels.get(s, 0), -s))
        if room[s] < quota:
            break
        put(quota, s)
        copies -= quota
    while copies:
        whole = [s for s, r in enumerate(room) if r >= copies]
        if whole:
            # where most of its documents are, then where it leaves least
            put(copies, max(whole, key=lambda s: (labels.get(s, 0), -room[s], -s)))
            break
        s = max(range(len(room)), key=lambda s: (room[s], -s))
        take = min(room[s], copies)
        copies -= take
        put(take, s)
    return parts


def balanced_shards(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law ("rows"), shard, slot, grown_shard (null), copies (rows of its text).

    ``size`` is the text's UTF-8 bytes plus 16; a null text has none, its checksum is that of no bytes, and it is
    linked with empty texts. Shards hold equal counts, at most one apart; slots are gapless from 0 in each shard, in
    the order of a hash. Repeated rows are placed one by one. An empty table gives no rows. Other columns are ignored.
    Where a row goes hangs on doc_id and text alone (for repeated rows: on how many there are), not on the files or partitions it comes from.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    digested = src.select("doc_id", (F.octet_length("text") + 16).cast("long").alias("size"), F.crc32("text").alias("text_crc32"), F.unhex(F.sha2("text", 256)).alias("digest"), F.monotonically_increasing_id().alias("row"))
    base = written(digested, "texts")
    n = base.count()
    again = base.groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("k")).where("k > 1").head(1)
    if again:
        # rows alike in text and identifier are told apart by a number; which of them has which does not show
        base = written(with_rank(base, "nth", hash63("row"), ["row"], within=["digest", "doc_id"], per_bucket=1000, total=n), "numbered")
    base = base.withColumn("key", hash63("doc_id", "digest", "nth") if again else hash63("doc_id", "digest")).drop("row", "nth")
    quota = [n // shards + (s < n % shards) for s in range(shards)]
    least = max(1, n // shards)
    first = F.pmod(F.col("key"), F.lit(shards)).cast("int")
    cohorts = written(base.groupBy("digest", first.alias("first")).agg(F.count(F.lit(1)).alias("k")), "cohorts")
    groups = written(cohorts.groupBy("digest").agg(F.sum("k").alias("copies"), F.array_sort(F.collect_list(F.struct((-F.col("k")).alias("k"), F.xxhash64("digest", "first").alias("h"), "first"))).alias("labels")), "groups")  # a label a shard at most
    bound = groups.where("copies > 1")
    many = int(bound.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0])

    room = list(quota)
    fixed: list[tuple[bytes, int, int, int]] = []  # digest, from, to (places in the group), shard

    def fix(rows: list) -> None:
        for r in sorted(rows, key=lambda r: (-r["copies"], r["digest"])):
            at = 0
            for size, s in cut_up(int(r["copies"]), room, {x["first"]: -x["k"] for x in r["labels"]}, least):
                fixed.append((bytes(r["digest"]), at, at + size, s))
                at += size

    fix(bound.where(F.col("copies") > least // 4).collect() if least >= 4 else bound.where(F.col("copies") >= least).collect())  # five a shard at most
    left = bound.where(F.col("copies") <= least // 4) if least >= 4 else bound.where(F.col("copies") < least)
    placed: list[DataFrame] = []
    for turn in range(rounds):
        ask = F.element_at("labels", (F.pmod(F.lit(turn), F.size("labels")) + 1).cast("int"))["first"]
        asked = left.withColumn("to", ask).withColumn("bucket", F.pmod(F.xxhash64("digest", F.lit(turn)), F.lit(BUCKETS)).cast("int"))
        wish = asked.groupBy("to", "bucket").agg(F.sum("copies").alias("n")).collect()  # shards x BUCKETS rows at most
        taken = []
        for r in sorted(wish, key=lambda r: (r["to"], r["bucket"])):
            if r["n"] <= room[r["to"]]:
                room[r["to"]] -= int(r["n"])
                taken.append(r["to"] * BUCKETS + r["bucket"])
        if not taken:
            break
        yes = set(taken)
        flags = spark.sql("SELECT " + "'" + "".join("1" if i in yes else "0" for i in range(shards * BUCKETS)) + "' AS flags")
        asked = asked.crossJoin(F.broadcast(flags)).withColumn("admitted", F.substring("flags", F.col("to") * BUCKETS + F.col("bucket") + 1, F.lit(1)) == "1")
        asked = written(asked.select("digest", "copies", "labels", "to", "admitted"), "asked")
        placed.append(asked.where("admitted").select("digest", F.col("to").alias("shard")))
        left = asked.where(~F.col("admitted")).select("digest", "copies", "labels")

    # the groups left, along the room left
    rest = left.count()
    if rest:
        spread = F.floor(hash63("digest").cast("double") / F.lit(float(2**63)) * max(1, -(-rest // 20_000))).cast("long")
        line = written(left.withColumn("bucket", spread), "left")
        sums = line.groupBy("bucket").agg(F.sum("copies").alias("n"))
        starts = sums.select("bucket", F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
        upto = F.sum("copies").over(Window.partitionBy("bucket").orderBy("digest").rowsBetween(Window.unboundedPreceding, 0))
        ends, total = [], 0
        for r in room:
            total += r
            ends.append(total)
        line = line.withColumn("upto", upto).join(F.broadcast(starts), "bucket").withColumn("upto", F.col("upto") + F.col("start"))
        borders = F.array(*[F.lit(int(e)).cast("long") for e in ends])
        passed = lambda x: F.size(F.filter(borders, lambda e: e <= x))
        line = line.select("digest", "copies", "labels", passed(F.col("upto") - F.col("copies")).alias("shard"), passed(F.col("upto") - 1).alias("last"))
        line = written(line, "line")
        inside = line.where("shard = last")
        for r in inside.groupBy("shard").agg(F.sum("copies").alias("n")).collect():  # one row a shard
            room[r["shard"]] -= int(r["n"])
        placed.append(inside.select("digest", "shard"))
        fix(line.where("shard <> last").select("digest", "copies", "labels").collect())  # fewer than there are shards

    ends, total = [], 0
    for r in room:
        total += r
        ends.append(total)
    cols = ["key", "doc_id", "size", "text_crc32", "copies"]
    order = ["doc_id", "text_crc32", "size"]
    # few groups, but perhaps most rows: they are found by a broadcast and numbered in buckets
    parts = written(spark.createDataFrame([(bytearray(d), lo, hi, s) for d, lo, hi, s in fixed], "digest binary, lo long, hi long, shard int"), "parts")
    heads = parts.groupBy("digest").agg(F.max("hi").alias("copies"))
    own = written(base.join(F.broadcast(heads), "digest"), "fixed")
    numbered = with_rank(own, "rank", F.col("key"), order, within=["digest"], per_bucket=1000)
    where = parts.groupBy("digest").agg(F.collect_list(F.struct("lo", "hi", "shard")).alias("parts"))
    mine = F.filter("parts", lambda p: (p["lo"] <= F.col("rank")) & (F.col("rank") < p["hi"]))
    big = numbered.join(F.broadcast(where), "digest").select(*cols, F.element_at(mine, 1)["shard"].alias("shard"))
    others = base.join(F.broadcast(heads.select("digest")), "digest", "left_anti").join(groups.select("digest", "copies"), "digest")
    kept = placed[0] if placed else None
    for p in placed[1:]:
        kept = kept.unionByName(p)
    small = others.where("copies > 1").join(kept, "digest").select(*cols, "shard") if kept is not None else None
    free = with_rank(others.where("copies = 1"), "rank", F.col("key"), order, total=n - many)
    passed = F.filter(F.array(*[F.lit(int(e)).cast("long") for e in ends]), lambda e: e <= F.col("rank"))
    all_ = free.select(*cols, F.size(passed).alias("shard")).unionByName(big)
    if small is not None:
        all_ = all_.unionByName(small)
    placed_rows = written(all_, "placed").repartition(width(spark))
    out = with_rank(placed_rows, "slot", F.xxhash64("key", F.lit(1)).bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF)), order, within=["shard"], per_bucket=200_000, total=n)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "copies")
