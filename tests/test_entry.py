import __spark_entry__ as entry


def test_entry_and_names(spark):
    df = entry.entry(spark)
    assert df.columns == ["gather", "sample_index", "stack", "fold"] and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
