import zlib
from collections import Counter, defaultdict

import pytest

from lexispark.llm.sharding import balanced_shards

SCHEMA = "doc_id long, text string, shard string, copies long, row int"


def check(rows, got, shards):
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    text = {r[0]: r[1] for r in rows}  # one text an identifier
    counts = Counter(r.shard for r in got)
    sizes = [counts.get(s, 0) for s in range(shards)]
    assert sum(sizes) == len(rows) and max(sizes) - min(sizes) <= 1
    slots = defaultdict(list)
    for r in got:
        raw = (text[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "rows", None)
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


@pytest.mark.parametrize("hot", [0, 400])
def test_even_gapless_and_together(spark, hot):
    rows = [(i, f"text {i}", "x", 1, 2) for i in range(900)]
    rows += [(1000 + 3 * g + k, f"copy {g}", "x", 1, 2) for g in range(60) for k in range(3)]
    rows += [(5000 + k, "the hot text é", "x", 1, 2) for k in range(hot)]
    rows += [(None, "no id", "x", 1, 2), (9000, None, "x", 1, 2), (9001, "", "x", 1, 2), (9001, "", "x", 1, 2)]
    got = balanced_shards(spark.createDataFrame(rows, SCHEMA), shards=8).collect()
    check(rows, got, 8)
    where = {r.doc_id: r.shard for r in got}
    cut = sum(len({where[1000 + 3 * g + k] for k in range(3)}) > 1 for g in range(60))
    assert cut <= 6
    # other partitions and another order of the rows give the same places
    again = balanced_shards(spark.createDataFrame(rows[::-1], SCHEMA).repartition(5), shards=8).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))


def test_alike_rows_and_long_texts(spark):
    rows = [(7, "alike", "x", 1, 2)] * 300 + [(None, "alike", "x", 1, 2)] * 200 + [(i, "long " * 40000 + str(i % 2), "x", 1, 2) for i in range(10, 14)]
    got = balanced_shards(spark.createDataFrame(rows, SCHEMA).repartition(3), shards=8).collect()
    check(rows, got, 8)
    again = balanced_shards(spark.createDataFrame(rows, SCHEMA).repartition(4), shards=8).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))


@pytest.mark.parametrize("n", [0, 1, 5])
def test_fewer_rows_than_shards(spark, n):
    rows = [(i, "same", "x", 1, 2) for i in range(n)]
    check(rows, balanced_shards(spark.createDataFrame(rows, SCHEMA), shards=8).collect(), 8)


def cut_rows(rows, got):
    """Rows outside the main shard of their text."""
    text, by = {r[0]: r[1] for r in rows}, defaultdict(Counter)
    for r in got:
        by[text[r.doc_id]][r.shard] += 1
    return sum(sum(c.values()) - max(c.values()) for c in by.values())


def test_every_row_has_a_copy(spark):
    rows = [(3 * g + k, f"copy {g}", "x", 1, 2) for g in range(400) for k in range(3)]
    got = balanced_shards(spark.createDataFrame(rows, SCHEMA), shards=8).collect()
    check(rows, got, 8)
    assert cut_rows(rows, got) <= 14  # a cut group for each border at most


@pytest.mark.parametrize(("copies", "shards_of_it"), [(40, 1), (90, 1), (350, 4)])
def test_large_groups_are_cut_no_more_than_needed(spark, copies, shards_of_it):
    rows = [(k, "the hot text", "x", 1, 2) for k in range(copies)] + [(1000 + 2 * g + k, f"copy {g}", "x", 1, 2) for g in range((800 - copies) // 2) for k in range(2)]
    got = balanced_shards(spark.createDataFrame(rows, SCHEMA), shards=8).collect()
    check(rows, got, 8)
    assert len({r.shard for r in got if r.doc_id < copies}) == shards_of_it
