from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexispark.operators import digests

SCHEMA = "id long, name string, v double"


def _table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def _rows(n):
    return [(i, f"n{i % 7}", i / 3) for i in range(n)] + [(None, None, None), (None, None, None), (5, "again", None)]


def _write(spark, tmp_path, name, rows, depth=1):
    path = f"file://{tmp_path}/{name}"
    digests.write_with_tree(_table(spark, rows).repartition(3), path, ["id"], depth)
    return path


def _difference(spark, a, b):
    rows, nodes = digests.tree_differences(spark, a, b, _table(spark, []).schema)
    return Counter(tuple(r) for r in rows.collect()), nodes, rows


def test_one_changed_row_reads_one_range(spark, tmp_path):
    rows = _rows(2000)
    changed = [(i, n, -1.0 if i == 77 else v) for i, n, v in rows]
    a, b = _write(spark, tmp_path, "a", rows, 2), _write(spark, tmp_path, "b", changed, 2)
    got, nodes, frame = _difference(spark, a, b)
    assert got == Counter({(77, "n0", 77 / 3, "left"): 1, (77, "n0", -1.0, "right"): 1})
    assert len(nodes) == 1 and {f.split("__range=")[1].split("/")[0] for f in frame.inputFiles()} == {f"r{nodes[0]}"}
    assert digests.read_tree(spark, a).where("level = 2").count() > 200


def test_equal_tables_read_nothing(spark, tmp_path):
    rows = _rows(300)
    a, b = _write(spark, tmp_path, "a", rows), _write(spark, tmp_path, "b", rows[::-1])
    got, nodes, frame = _difference(spark, a, b)
    assert not got and nodes == [] and frame.inputFiles() == []
    root = [t.where("level = 0").first() for t in (digests.read_tree(spark, a), digests.read_tree(spark, b))]
    assert root[0] == root[1] and root[0].n == len(rows)


def test_repeats_gains_and_losses(spark, tmp_path):
    rows = _rows(200)
    other = [r for r in rows if r[0] != 12] + [(900, "new", None), (3, "n3", 1.0), (3, "n3", 1.0), (None, None, None)]
    a, b = _write(spark, tmp_path, "a", rows, 1), _write(spark, tmp_path, "b", other, 1)
    got, _, _ = _difference(spark, a, b)
    want = Counter({(*r, "left"): k for r, k in (Counter(rows) - Counter(other)).items()}) + Counter({(*r, "right"): k for r, k in (Counter(other) - Counter(rows)).items()})
    assert got == want
    assert got[(None, None, None, "right")] == 1 and got[(3, "n3", 1.0, "right")] == 2  # the one that both have is no difference


def test_empty_tables_and_errors(spark, tmp_path):
    a, b = _write(spark, tmp_path, "a", []), _write(spark, tmp_path, "b", _rows(20))
    c = _write(spark, tmp_path, "c", [])
    assert not _difference(spark, a, c)[0]
    assert sum(_difference(spark, a, b)[0].values()) == sum(_difference(spark, b, a)[0].values()) == 23
    d = _write(spark, tmp_path, "d", _rows(20), 2)
    with pytest.raises(ValueError):
        _difference(spark, b, d)
    with pytest.raises(ValueError):
        digests.digest_tree(_table(spark, []), ["id"], 9)
    with pytest.raises(ValueError):
        digests.write_with_tree(_table(spark, []).withColumn("__range", F.lit(1)), f"file://{tmp_path}/e", ["id"])


def test_tree_is_of_rows_not_of_order(spark):
    rows = _rows(100)
    one, two = (sorted(map(tuple, digests.digest_tree(_table(spark, r).repartition(k), ["id"], 2).collect())) for r, k in ((rows, 1), (rows[::-1], 5)))
    assert one == two
    doubled = digests.digest_tree(_table(spark, [*rows, rows[4]]), ["id"], 2).where("level = 0").first()
    assert doubled.n == len(rows) + 1 and doubled.digest != one[0][3]
