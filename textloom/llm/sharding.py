"""Longest-processing-time sharding of groups that must stay together."""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import written
from textloom.plans.skew import hot_cells, skew_join


def _level(loads: list[int], size: int, n: int) -> list[int]:
    """How many of n equal items each shard gets when each goes to the least-loaded shard, the lowest number on ties.

    The greedy rule takes the n smallest start loads among load + j * size, so the last level taken is found by bisection.
    """

    def taken(level: int) -> list[int]:
        return [max(0, (level - x) // size + 1) if level >= x else 0 for x in loads]

    low, high = min(loads) - 1, max(loads) + n * size
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (low, mid) if sum(taken(mid)) >= n else (mid, high)
    counts = taken(low)
    left = n - sum(counts)
    for i, x in enumerate(loads):
        if left and high >= x and (high - x) % size == 0:
            counts[i] += 1
            left -= 1
    return counts


def lpt(sizes: Iterable[tuple[int, int]], n_shards: int) -> Iterator[tuple[int, list[int], list[int]]]:
    """For (size, number of groups of that size), largest first: the size, running ends of ranges of groups, their shards.

    Groups of one size are alike, so each size is dealt out at once: through a heap where few, by the heap's final level
    where many. The loads are those of the rule applied group by group.
    """
    heap = [(0, i) for i in range(n_shards)]
    for size, n in sizes:
        counts: dict[int, int] = {}
        if size > 0 and n > 4 * n_shards:
            loads = [x for _, x in sorted((i, x) for x, i in heap)]
            more = _level(loads, size, n)
            heap = [(x + c * size, i) for i, (x, c) in enumerate(zip(loads, more, strict=True))]
            heapq.heapify(heap)
            counts = {i: c for i, c in enumerate(more) if c}
        else:
            for _ in range(n):
                load, i = heap[0]
                heapq.heapreplace(heap, (load + size, i))
                counts[i] = counts.get(i, 0) + 1
        ends, at = [], 0
        for c in counts.values():
            ends.append(at := at + c)
        yield size, ends, list(counts)


def shard_groups(
    docs: DataFrame, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text", salts: int = 64, slot_buckets: int = 256
) -> DataFrame:
    """Puts every row into one of n_shards; rows of equal text stay together; law ``bytes``.

    A row weighs the UTF-8 bytes of its text plus 8; a group weighs the sum of its rows. Groups go by size, largest
    first, to the least-loaded shard. The rule goes from size to size, so one task reads the histogram of group sizes in
    order, batch by batch, and holds the heap alone: with D distinct sizes the corpus has at least D*D/2 bytes, so D is at
    most the square root of twice its bytes (250,000 for 30 GB, 14 million for 100 TB). Rows of a common text and groups
    of a common size are dealt over salts where they are joined.

    Returns doc_id, size, text_crc32, law, shard, slot, group_bytes. Slots run from 0 without a gap in each shard.
    Null texts form one group apart from empty texts, both of weight 8 a row. Null ids and repeated rows are rows like
    any other. An empty table gives an empty result. Other columns are ignored. A group heavier than an even share of
    the bytes still stays whole, so its shard is heavier than the rest.
    """
    text = F.col(text_col)
    rows = written(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8).alias("size"),
            F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
            F.coalesce(F.sha2(text, 256), F.lit("null")).alias("g"),
        ),
        "shard-rows",
    )
    groups = rows.groupBy("g").agg(F.sum("size").alias("group_bytes")).withColumn("salt", F.pmod(F.xxhash64("g"), F.lit(salts)))
    groups = written(groups, "shard-groups")
    hist = groups.groupBy("group_bytes", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("group_bytes").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = hist.select("group_bytes", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One task goes through the sizes, largest first; it holds the heap and one batch of sizes at a time."""

        def sizes() -> Iterator[tuple[int, int]]:
            for batch in batches:
                yield from zip(batch.column("group_bytes").to_pylist(), batch.column("n").to_pylist(), strict=True)

        found = lpt(sizes(), n_shards)
        while part := list(islice(found, 5000)):
            size, ends, shards = zip(*part, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(size), pa.array(ends, pa.list_(pa.int64())), pa.array(shards, pa.list_(pa.int32()))], ["group_bytes", "ends", "shards"])

    ordered = hist.groupBy("group_bytes").agg(F.sum("n").alias("n")).orderBy(F.desc("group_bytes")).coalesce(1)
    ranges = written(ordered.mapInArrow(dealt, "group_bytes long, ends array<long>, shards array<int>"), "shard-ranges")
    within = Window.partitionBy("group_bytes", "salt").orderBy("g")
    placed = (
        groups.withColumn("rank", F.row_number().over(within) - 1)
        .join(offsets, ["group_bytes", "salt"])
    )
    placed = (
        skew_join(placed, ranges, "group_bytes", hot_cells(groups, "group_bytes"))
        .select(
            "g",
            "group_bytes",
            F.element_at("shards", F.size(F.filter("ends", lambda e: e <= F.col("first") + F.col("rank"))) + 1).alias("shard"),
        )
    )
    full = written(
        skew_join(rows, placed, "g", hot_cells(rows, "g")).select(
            "doc_id", "size", "text_crc32", "shard", "group_bytes", "g", F.pmod(F.xxhash64("doc_id", "g"), F.lit(slot_buckets)).alias("sub")
        ),
        "shard-placed",
    )
    counts = full.groupBy("shard", "sub").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("shard").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "sub", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("first"))
    inside = Window.partitionBy("shard", "sub").orderBy("doc_id", "g")
    return (
        full.withColumn("rank", F.row_number().over(inside) - 1)
        .join(starts, ["shard", "sub"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("first") + F.col("rank")).cast("long").alias("slot"),
            "group_bytes",
        )
    )
