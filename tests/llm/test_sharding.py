import heapq
import random
import zlib

import pytest
from textloom.llm.sharding import lpt, shard_groups

SCHEMA = "doc_id long, text string, size string, shard string"


def brute(sizes, n):
    heap = [(0, i) for i in range(n)]
    for s in sorted(sizes, reverse=True):
        load, i = heapq.heappop(heap)
        heapq.heappush(heap, (load + s, i))
    return sorted(x for x, _ in heap)


@pytest.mark.parametrize("seed", range(6))
def test_lpt_loads_equal_the_rule_group_by_group(seed):
    r = random.Random(seed)
    sizes = [r.choice([8, 9, 20, 100, 1000]) for _ in range(900)] + [r.randrange(8, 5000) for _ in range(50)]
    hist = sorted(((s, sizes.count(s)) for s in set(sizes)), reverse=True)
    loads = [0] * 7
    for size, ends, shards in lpt(hist, 7):
        at = 0
        for end, shard in zip(ends, shards):
            loads[shard] += size * (end - at)
            at = end
    assert sorted(loads) == brute(sizes, 7)


def test_shards(spark):
    r = random.Random(1)
    texts = ["copy" * 5] * 150 + [None] * 20 + [""] * 20 + ["ä" * r.randrange(1, 400) for _ in range(250)] + ["x" * 20000]
    rows = [(i if i % 50 else None, t, "a", "b") for i, t in enumerate(texts)] + [(7, "same", "a", "b")] * 3
    got = shard_groups(spark.createDataFrame(rows, SCHEMA), n_shards=5).toPandas()
    assert len(got) == len(rows)
    by = {(row[0], row[1]) for row in rows}
    for t in {t for _, t in by}:
        n = 8 + len((t or "").encode())
        assert len(got) and (got[(got["size"] == n) & (got.text_crc32 == zlib.crc32((t or "").encode()))].shape[0] > 0)
    assert got[got.text_crc32 == zlib.crc32(b"copy" * 5)].shard.nunique() == 1
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    groups = {}
    for _, t, *_ in rows:
        groups[t] = groups.get(t, 0) + 8 + len((t or "").encode())
    assert sorted(got.groupby("shard")["size"].sum()) == [x for x in brute(groups.values(), 5) if x]


def test_empty(spark):
    assert shard_groups(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_on_a_real_table_equals_the_rule(spark):
    """Whole result of the query: sizes, checksums, groups together, loads as the rule gives them, slots without gaps."""
    from textloom.llm.queries import op6_sharding

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").toPandas().set_index("doc_id").text
    got = op6_sharding(spark, "/root/testdata/sf0.001").toPandas()
    assert sorted(got.doc_id) == sorted(docs.index) and set(got.law) == {"bytes"} and got.grown_shard.isna().all()
    text = [docs[i] or "" for i in got.doc_id]
    assert got["size"].tolist() == [len(t.encode()) + 8 for t in text] and got.text_crc32.tolist() == [zlib.crc32(t.encode()) for t in text]
    assert (got.assign(t=text).groupby("t").shard.nunique() == 1).all()
    loads = brute(got.assign(t=text).groupby("t")["size"].sum().tolist(), 24)
    assert sorted(got.groupby("shard")["size"].sum().reindex(range(24), fill_value=0)) == loads
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
