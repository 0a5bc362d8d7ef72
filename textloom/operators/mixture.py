"""Source mixing and fixed-length packing in order."""

from __future__ import annotations

import hashlib
from bisect import bisect
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.operators.minhash import pieces, text_buffers
from textloom.workspace import written


def _ranged(rows: DataFrame, *order: Column | str) -> DataFrame:
    """rows with ``__pos``, the place in the order from 0, with ``__part``: the range of the order that holds the row.

    The sorted rows are stored with their partition and place first: bounds of ranges are drawn anew whenever a sort is
    computed again, so counts and rows must come from one computation. The counts, one a range, give each range's first place.
    """
    held = written(rows.orderBy(*order).withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()), "ranged")
    counts = held.groupBy("__part").agg(F.count("*").alias("n"), F.min("__at").alias("__low"))
    ahead = Window.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("__part", "__low", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("__first"))
    return held.join(F.broadcast(first), "__part").withColumn("__pos", F.col("__first") + F.col("__at") - F.col("__low")).drop("__at", "__low", "__first")


def with_position(rows: DataFrame, *order: Column | str) -> DataFrame:
    """rows with ``pos``, the place in the order from 0: each place once. Rows are ranked inside their range alone."""
    return _ranged(rows, *order).withColumnRenamed("__pos", "pos").drop("__part")


def ranked(rows: DataFrame, group: str, order: str, name: str) -> DataFrame:
    """rows with ``name``, the place in the order among the rows of one group, from 0; no group is gathered in one task."""
    placed = _ranged(rows, group, order).drop("__part")
    begins = placed.groupBy(group).agg(F.min("__pos").alias("__begin"))
    return placed.join(F.broadcast(begins), group).withColumn(name, F.col("__pos") - F.col("__begin")).drop("__pos", "__begin")


def draws(spark: SparkSession, shares: dict[str, float], steps: int, seed: int = 42, first: int = 0) -> DataFrame:
    """step, source: which source each step from ``first`` to before ``steps`` draws from; seed and step alone decide."""
    edges = list(accumulate(shares.values()))
    u = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.col("id").cast("string"))), 1, 8), 16, 10).cast("double") / float(1 << 32) * edges[-1]
    choice = F.lit(list(shares)[-1])
    for name, edge in reversed(list(zip(shares, edges))[:-1]):
        choice = F.when(u < edge, name).otherwise(choice)
    return spark.range(first, steps).select(F.col("id").alias("step"), choice.alias("source"))


def steps_to_exhaust(sizes: dict[str, int], shares: dict[str, float], seed: int = 42, most: int = 10_000_000) -> int:
    """Steps until every source has been drawn from as often as it has rows: when mixing stops."""
    names, edges = list(shares), list(accumulate(shares.values()))
    left = {k: v for k, v in sizes.items() if v}
    for step in range(most):
        if not left:
            return step
        u = int(hashlib.md5(f"{seed}|{step}".encode()).hexdigest()[:8], 16) / (1 << 32) * edges[-1]
        name = names[min(bisect(edges, u), len(names) - 1)]
        if name in left:
            left[name] -= 1
            if not left[name]:
                del left[name]
    raise ValueError(f"a source is not exhausted after {most} steps")


def steps_until_exhausted(rows: DataFrame, shares: dict[str, float], source_col: str = "source", seed: int = 42, blocks: int = 1000) -> int:
    """What ``steps_to_exhaust`` gives, without a bound: the draws are counted in blocks of steps, on the executors.

    The steps looked at double until each source has draws enough; then the block of each source's last needed draw is
    divided again. At most ``blocks`` counts a source reach the driver.
    """
    spark = rows.sparkSession
    need = {r[0]: r[1] for r in rows.where(F.col(source_col).isin(*shares)).groupBy(source_col).agg(F.count("*")).collect()}
    if never := [k for k in need if shares[k] <= 0]:
        raise ValueError(f"sources that are never drawn from: {never}")

    def counted(low: int, high: int, size: int) -> dict[str, dict[int, int]]:
        block = F.floor((F.col("step") - low) / F.lit(size)).cast("long").alias("block")
        out: dict[str, dict[int, int]] = {k: {} for k in shares}
        for r in draws(spark, shares, high, seed, low).groupBy("source", block).agg(F.count("*").alias("n")).collect():
            out[r["source"]][r["block"]] = r["n"]
        return out

    def place(have: dict[int, int], left: int) -> tuple[int, int]:
        """The block that holds the draw number ``left``, and that draw's number within it."""
        for block in sorted(have):
            if left <= have[block]:
                return block, left
            left -= have[block]
        raise ValueError("too few draws")

    total = sum(shares.values())
    high = int(1.05 * max((n * total / shares[k] for k, n in need.items()), default=0)) + 1000
    while True:
        size = -(-high // blocks)
        have = counted(0, high, size)
        if all(sum(have[k].values()) >= n for k, n in need.items()):
            break
        high *= 2
    last = 0
    for k, n in need.items():
        low, width, (block, left) = 0, size, place(have[k], n)
        while True:
            low += block * width
            if width == 1:
                break
            step = -(-width // blocks)
            block, left = place(counted(low, low + width, step)[k], left)
            width = step
        last = max(last, low + 1)
    return last


def interleave(rows: DataFrame, drawn: DataFrame, source_col: str = "source", *, order: str = "doc_id") -> DataFrame:
    """step, source and a row's columns: the k-th draw from a source takes its row k modulo its size, so short ones repeat."""
    placed = ranked(rows, source_col, order, "__at")
    sizes = rows.groupBy(source_col).agg(F.count("*").alias("__size"))
    taken = ranked(drawn, "source", "step", "__k").join(F.broadcast(sizes.withColumnRenamed(source_col, "source")), "source")
    taken = taken.select("step", F.col("source").alias(source_col), (F.col("__k") % F.col("__size")).alias("__at"))
    return taken.join(placed, [source_col, "__at"]).drop("__at")


def pack_sequences(rows: DataFrame, length: int, batch: int = 64, end_id: int = 0, pos_col: str = "pos", ids_col: str = "ids") -> DataFrame:
    """seq_batch, seq, ids: in batches of ``batch`` rows by position, ids and an end id after each row, cut to ``length``.

    What is left over at the end of a batch is dropped, as training does. A batch has a fixed number of rows.
    """
    ended = rows.select(F.floor(F.col(pos_col) / batch).cast("long").alias("seq_batch"), F.struct(F.col(pos_col).alias("pos"), F.concat(F.col(ids_col), F.array(F.lit(end_id))).alias("ids")).alias("r"))
    flat = ended.groupBy("seq_batch").agg(F.flatten(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["ids"])).alias("all"))
    full = F.floor(F.size("all") / length).cast("int")
    seqs = flat.where(full > 0).select("seq_batch", "all", F.explode(F.sequence(F.lit(0), full - 1)).alias("seq"))
    return seqs.select("seq_batch", F.col("seq").cast("long").alias("seq"), F.slice("all", F.col("seq") * length + 1, F.lit(length)).alias("ids"))


def tokenize(text: Column, encode=None) -> Column:
    """array<int> of a text by a plug-in that encodes a list of strings; without one the bytes are the ids."""

    @F.arrow_udf("array<int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return encoded(batches, encode)

    return run(text)


def encoded(batches: Iterator[pa.Array], encode=None) -> Iterator[pa.Array]:
    """Lists of ids for batches of texts, in pieces of a quarter of a megabyte of text.

    A worker holds a batch of texts and the ids of one piece. Bytes become ids without a Python object for each.
    """
    for texts in batches:
        offsets, data = text_buffers(texts)
        for at, to in pieces(offsets):
            if encode:
                yield pa.array(encode(texts.slice(at, to - at).fill_null("").to_pylist()), pa.list_(pa.int32()))
            else:
                starts = offsets[at : to + 1] - offsets[at]
                yield pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(data[offsets[at] : offsets[to]].astype(np.int32)))


def skip(rows: DataFrame, n: int, *order: Column | str) -> DataFrame:
    return rows.orderBy(*order).offset(n)


def buffer_shuffle(rows: DataFrame, size: int, seed: int = 42, pos_col: str = "pos") -> DataFrame:
    """Rows in seeded order within buffers of ``size`` neighbours: column ``shuffled`` orders them."""
    key = F.md5(F.concat(F.lit(f"{seed}|"), F.col(pos_col).cast("string")))
    rank = F.row_number().over(Window.partitionBy(F.floor(F.col(pos_col) / size)).orderBy(key, pos_col)) - 1
    return rows.withColumn("shuffled", (F.floor(F.col(pos_col) / size) * size + rank).cast("long"))


def mean_embedding(parts: DataFrame, vectors: DataFrame, key: str = "piece", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """key, dim, value: the mean of each key's parts' vectors. Dimensions are aggregated as rows and never collected."""
    held = parts.join(vectors.select(id_col, vector_col), id_col)
    each = held.select(key, F.posexplode(vector_col).alias("dim", "v"))
    return each.groupBy(key, F.col("dim").cast("long").alias("dim")).agg(F.avg(F.col("v").cast("double")).alias("value"))
