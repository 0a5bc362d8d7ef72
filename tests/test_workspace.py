from textloom.workspace import clear, written


def test_tables_are_kept_until_cleared(spark):
    df = written(spark.range(5), "t")
    assert df.count() == 5 and df.columns == ["id"]
    path = df.inputFiles()[0]
    assert clear(spark) >= 1 and clear(spark) == 0
    try:
        spark.read.parquet(path).count()
        raise AssertionError
    except Exception as e:
        assert not isinstance(e, AssertionError)
