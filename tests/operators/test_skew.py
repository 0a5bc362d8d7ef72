from pyspark.sql import functions as F
from textloom.plans.skew import hot_cells, skew_join


def test_a_hot_key_is_dealt_over_salts_and_joins_as_usual(spark):
    rows = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    few = spark.range(0, 30_000, 7).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w")).unionByName(spark.createDataFrame([(7, 1)], "k long, w long"))
    hot = hot_cells(rows, "k", cells=256)
    assert 1 <= hot.count() <= 64
    for how in ("inner", "left"):
        got = skew_join(rows, few, "k", hot, how, salts=8, cells=256)
        want = rows.join(few, "k", how)
        assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_empty_and_even(spark):
    rows = spark.range(100).select(F.col("id").alias("k"))
    assert hot_cells(rows, "k").count() == 0 and hot_cells(rows.limit(0), "k").count() == 0
    assert skew_join(rows.limit(0), rows, "k", hot_cells(rows, "k")).count() == 0
    assert skew_join(rows, rows, "k", hot_cells(rows, "k")).count() == 100
