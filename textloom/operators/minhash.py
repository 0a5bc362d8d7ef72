"""MinHash signatures with banding, as declared by seed, permutations and rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

PRIME = (1 << 61) - 1


@lru_cache(maxsize=8)
def coefficients(perms: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and offsets drawn from the legacy seeded generator, whose stream is frozen."""
    r = np.random.RandomState(seed)
    a = r.randint(1, PRIME, perms, dtype=np.int64).astype(np.uint64)
    b = r.randint(0, PRIME, perms, dtype=np.int64).astype(np.uint64)
    return a, b


def signatures(hashes: np.ndarray, counts: np.ndarray, a: np.ndarray, b: np.ndarray, block: int = 8192) -> np.ndarray:
    """A row a set of the least value of each permutation; ``counts`` says how many of ``hashes`` each set has.

    Products wrap at 64 bits before the remainder is taken. That needs no division: 2**61 is 1 modulo ``PRIME``, so the
    upper three bits are added to the others, and a value that then reaches the prime is the greater of y and y - PRIME.
    An empty set has the greatest number. Permutations go one after the other over blocks that stay in cache.
    """
    found = np.full((len(a), len(counts)), np.iinfo(np.uint64).max, np.uint64)
    ends = np.cumsum(counts)
    p, shift = np.uint64(PRIME), np.uint64(61)
    y, z = np.empty(min(block, len(hashes)), np.uint64), np.empty(min(block, len(hashes)), np.uint64)
    for at in range(0, len(hashes), block):
        h = hashes[at : at + block]
        low, high = np.searchsorted(ends, [at, at + len(h) - 1], "right")
        sets = low + np.flatnonzero(counts[low : high + 1])
        first = np.maximum((ends - counts)[sets] - at, 0)
        u, v = y[: len(h)], z[: len(h)]
        for k in range(len(a)):
            np.multiply(h, a[k], out=u)
            np.add(u, b[k], out=u)
            np.right_shift(u, shift, out=v)
            np.bitwise_and(u, p, out=u)
            np.add(u, v, out=u)
            np.subtract(u, p, out=v)
            np.minimum(u, v, out=u)
            found[k, sets] = np.minimum(found[k, sets], np.minimum.reduceat(u, first))
    return found.T


def _keys(hashes: np.ndarray, counts: np.ndarray, a: np.ndarray, b: np.ndarray, bands: int, rows: int) -> pa.Array:
    sig = np.ascontiguousarray(signatures(hashes, counts, a, b), "<u8").view(np.uint8)
    held = [xxhash.xxh64_intdigest(s[k * rows * 8 : (k + 1) * rows * 8].tobytes()) for s in sig for k in range(bands)]
    keys = pa.array(np.array(held, np.uint64).view(np.int64))
    return pa.ListArray.from_arrays(pa.array(np.arange(len(counts) + 1, dtype=np.int32) * bands), keys)


def _rest(batch: pa.RecordBatch, gone: str, bands: pa.Array) -> pa.RecordBatch:
    kept = batch.drop_columns([gone])
    return pa.RecordBatch.from_arrays([*kept.columns, bands], [*kept.schema.names, "bands"])


def banded(sets: DataFrame, bands: int = 14, rows: int = 8, seed: int = 42, base: Callable[[str], int] | None = None) -> DataFrame:
    """The columns of sets but ``shingles``, and bands: array<bigint>, one 64-bit key a band, of unsigned values' bits.

    sets has a column ``shingles`` of strings. Rows go through in Arrow batches; numpy does the permutations.
    """
    hash_of = base or (lambda s: xxhash.xxh64_intdigest(s))
    schema = sets.drop("shingles").schema.add("bands", ArrayType(LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = coefficients(bands * rows, seed)
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                held = [s.as_py() or [] for s in batch.column("shingles")]
                counts = np.array([len(x) for x in held], np.int64)
                hashes = np.fromiter((hash_of(s) for x in held for s in x), np.uint64, int(counts.sum()))
                yield _rest(batch, "shingles", _keys(hashes, counts, a, b, bands, rows))

    return sets.mapInArrow(run, schema)


def pieces(offsets: np.ndarray, size: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``size`` bytes, or of one row, by the offsets of a column of strings."""
    at = 0
    while at < len(offsets) - 1:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield at, to
        at = to


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a column of strings. What a null spans is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return at, np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)


def word_hashes(offsets: np.ndarray, data: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of n words of texts whose words have one blank between them, and how many each text has."""
    low, high = offsets[:-1], offsets[1:]
    blanks = np.flatnonzero(data[offsets[0] : offsets[-1]] == 32) + offsets[0]
    before = np.searchsorted(blanks, offsets)
    words = np.diff(before) + 1
    begins = np.insert(blanks + 1, before[:-1], low)
    ends = np.insert(blanks, before[1:], high)
    counts = np.maximum(words - n + 1, 1)
    first = np.repeat(np.cumsum(words) - words, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    last = first + np.repeat(np.minimum(words, n) - 1, counts)
    held = memoryview(data)
    hashes = np.fromiter((xxhash.xxh64_intdigest(held[i:j]) for i, j in zip(begins[first].tolist(), ends[last].tolist())), np.uint64, len(first))
    return hashes, counts


def banded_texts(texts: DataFrame, n: int = 5, bands: int = 14, rows: int = 8, seed: int = 42) -> DataFrame:
    """What ``banded`` gives for the runs of n words of ``sig``, a text in signature view: shingles are cut in Python.

    The texts alone go through Arrow, a fifth of the bytes of 5-word shingles, and are worked on in pieces of a quarter
    of a megabyte, so a worker holds one batch (bounded in bytes by Spark) and little else. A null has null for bands.
    """
    schema = texts.drop("sig").schema.add("bands", ArrayType(LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = coefficients(bands * rows, seed)
        for batch in batches:
            offsets, data = text_buffers(batch.column("sig"))
            for at, to in pieces(offsets):
                part = batch.slice(at, to - at)
                hashes, counts = word_hashes(offsets[at : to + 1], data, n)
                keys = _keys(hashes, counts, a, b, bands, rows)
                yield _rest(part, "sig", pa.ListArray.from_arrays(keys.offsets, keys.values, mask=part.column("sig").is_null()))

    return texts.mapInArrow(run, schema)


def bucket_edges(banded: DataFrame, id_col: str = "doc_id", bands_col: str = "bands") -> DataFrame:
    """a, b: each document with the first of its bucket. A star a bucket: as many edges as members, never all pairs."""
    placed = banded.select(F.col(id_col).alias("id"), F.posexplode(bands_col).alias("band", "h"))
    first = placed.groupBy("band", "h").agg(F.min("id").alias("a"), F.count("*").alias("n")).where("n > 1").select("band", "h", "a")
    return placed.join(first, ["band", "h"]).where("id <> a").select("a", F.col("id").alias("b")).distinct()


def near_rate(train: DataFrame, others: DataFrame, bands_col: str = "bands", id_col: str = "doc_id", split_col: str = "split") -> DataFrame:
    """split, n, hits, rate: documents of other splits that share a band with one of train."""
    index = train.select(F.posexplode(bands_col).alias("band", "h")).distinct()
    placed = others.select(split_col, id_col, F.posexplode(bands_col).alias("band", "h"))
    hits = placed.join(index, ["band", "h"], "left_semi").select(split_col, id_col).distinct().groupBy(split_col).agg(F.count("*").alias("hits"))
    total = others.groupBy(split_col).agg(F.count("*").alias("n"))
    found = total.join(hits, split_col, "left").select(split_col, "n", F.coalesce("hits", F.lit(0).cast("long")).alias("hits"))
    return found.withColumn("rate", F.round(F.col("hits") / F.col("n"), 6))
