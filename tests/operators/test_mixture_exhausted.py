import pytest
from textloom import queries
from textloom.operators import mixture


@pytest.mark.parametrize("sizes,blocks", [({"a": 900, "b": 3}, 1000), ({"a": 40, "b": 700, "c": 1}, 7), ({"b": 1}, 2), ({}, 5)])
def test_steps_equal_the_plain_rule(spark, sizes, blocks):
    shares = {"a": 0.6, "b": 0.3, "c": 0.1}
    rows = spark.createDataFrame([(k,) for k, n in sizes.items() for _ in range(n)] + [("other",)], "source string")
    assert mixture.steps_until_exhausted(rows, shares, blocks=blocks) == mixture.steps_to_exhaust(sizes, shares)


def test_source_that_is_never_drawn(spark):
    with pytest.raises(ValueError):
        mixture.steps_until_exhausted(spark.createDataFrame([("b",)], "source string"), {"a": 1.0, "b": 0.0})


def test_query_takes_every_row(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet").where("lang IN ('en', 'fr', 'de', 'es')").select("doc_id")
    got = queries.QUERIES["mixture_exhausted"](spark, d).cache()
    assert docs.join(got, "doc_id", "left_anti").count() == 0
    assert docs.join(queries.QUERIES["mixture_interleave"](spark, d), "doc_id", "left_anti").count() > 0  # 2000 draws are not enough
    steps = got.selectExpr("count(*)", "max(step) + 1", "count(distinct step)").first()
    assert steps[0] == steps[1] == steps[2]
