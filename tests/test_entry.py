import __spark_entry__ as entry


def test_every_comparison_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 60


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert rows and "density" in rows[0].asDict()
