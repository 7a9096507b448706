import __spark_entry__ as e


def test_entry_and_keys(spark):
    assert e.entry(spark).count() == 7
    assert set(e.oracle_sql()) <= set(e.queries())
