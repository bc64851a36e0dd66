import __spark_entry__ as entry


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_names():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 150
