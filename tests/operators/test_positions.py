"""Places in an order at a size where sorted ranges are many, and what stands on them."""

import pytest
from pyspark.sql import functions as F
from textloom import queries
from textloom.operators import joins, mixture


@pytest.fixture(params=["true", "false"])
def wide(spark, request):
    """16 shuffle partitions, with adaptive execution and without."""
    names = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.enabled": request.param}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def test_each_place_once(wide, tmp_path):
    n = 500_000
    rows = wide.range(0, n, 1, 16).select(F.col("id"), F.xxhash64("id").alias("key"))
    mixture.with_position(rows, "key", "id").write.parquet(str(tmp_path / "p"))
    got = wide.read.parquet(str(tmp_path / "p"))
    assert got.agg(F.count("*"), F.countDistinct("pos"), F.min("pos"), F.max("pos"), F.countDistinct("id")).first()[:] == (n, n, 0, n - 1, n)
    held = got.toPandas().sort_values("pos")
    assert held.key.is_monotonic_increasing


def test_places_stand_for_ids_packs_and_shuffles(wide):
    n = 200_000
    rows = wide.range(0, n, 1, 16).select(F.xxhash64("id").alias("key"))
    named = joins.numbered(rows, "x", "key")
    assert named.select("id").distinct().count() == n
    mixed = mixture.buffer_shuffle(mixture.with_position(rows, "key"), 200)
    assert mixed.agg(F.countDistinct("shuffled"), F.max("shuffled")).first()[:] == (n, n - 1)
    ids = mixture.with_position(rows, "key").select("pos", F.array(F.lit(1), F.lit(2), F.lit(3)).alias("ids"))
    assert mixture.pack_sequences(ids, 64).count() == n // 64 * 4


def test_ties_and_nulls_have_places(wide):
    rows = wide.createDataFrame([(None,), (None,), (1,), (1,), (0,)], "k long")
    assert sorted(r.pos for r in mixture.with_position(rows, "k").collect()) == [0, 1, 2, 3, 4]
    assert mixture.with_position(rows.limit(0), "k").count() == 0


def test_ids_of_one_url_do_not_depend_on_partitions(spark, tmp_path):
    """Pages share urls: whatever the files and the order of rows in them, ids follow url, then page_id."""
    rows = [(i, f"u{i * 7 % 40:02d}") for i in range(400)]
    want = {(f"web_{k}", p) for k, (_, p) in enumerate(sorted((u, p) for p, u in rows))}
    for name, held in (("a", rows), ("b", rows[::-1])):
        spark.createDataFrame(held, "page_id long, url string").repartition(3 if name == "a" else 1).write.parquet(f"{tmp_path}/{name}/pages.parquet")
        assert {(r.id, r.page_id) for r in queries.QUERIES["numbered_ids"](spark, f"{tmp_path}/{name}").collect()} == want
