"""Near-duplicate detection by b-bit MinHash: banded candidates, bit-count estimates, exact confirmation."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import written
from textloom.operators.components import components
from textloom.llm.hashing import mix, shingle_hashes, text_chunks, word_hashes
from textloom.plans.skew import hot_cells, skew_join

#: 32 bands of 5 minima: a pair at similarity 0.8 shares no band once in 300,000 times, a pair at 0.2 shares one in 100.
BANDS, ROWS, BITS = 32, 5, 2
PERMUTATIONS = BANDS * ROWS
_A = (mix(np.arange(PERMUTATIONS, dtype=np.uint64) + np.uint64(1 << 50)) >> np.uint64(32)).astype(np.uint32)[:, None] | np.uint32(1)
_B = (mix(np.arange(PERMUTATIONS, dtype=np.uint64) + np.uint64(1 << 51)) >> np.uint64(32)).astype(np.uint32)[:, None]
_SHIFTS = np.arange(0, 64, BITS, dtype=np.uint64)
LONGS = PERMUTATIONS * BITS // 64


def minima(shingles: np.ndarray, block: int = 2048) -> np.ndarray:
    """The least value of each permutation over a set that is not empty."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    found = (_A * x[None, :block] + _B).min(axis=1)
    for at in range(block, len(x), block):
        np.minimum(found, (_A * x[None, at : at + block] + _B).min(axis=1), out=found)
    return found


def packed(least: np.ndarray) -> np.ndarray:
    """The low bits of the minima, side by side in longs."""
    low = (least & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(LONGS, -1)
    return np.bitwise_or.reduce(low << _SHIFTS, axis=1).view(np.int64)


def band_keys(least: np.ndarray) -> np.ndarray:
    rows = least.astype(np.uint64).reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        key = mix(key) + rows[:, k]
    return mix(key).view(np.int64)


def sketches(docs: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text_hash, n_shingles, key (128 bits of the set; null if empty), sig, bands of every row."""
    kept = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    id_type = dict(kept.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, data, offsets in text_chunks(batch.column("text")):
                sizes, keys, sigs, bands = [], [], [], []
                for s in shingle_hashes(*word_hashes(data, offsets), shingle):
                    sizes.append(len(s))
                    if len(s):
                        least = minima(s)
                        keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest())
                        sigs.append(packed(least))
                        bands.append(band_keys(least))
                    else:
                        keys.append(None)
                        sigs.append(None)
                        bands.append(None)
                longs = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(at, end - at),
                        batch.column("text_hash").slice(at, end - at),
                        pa.array(sizes, pa.int64()),
                        pa.array(keys, pa.string()),
                        pa.array(sigs, longs),
                        pa.array(bands, longs),
                    ],
                    ["doc_id", "text_hash", "n_shingles", "key", "sig", "bands"],
                )

    return kept.mapInArrow(run, f"doc_id {id_type}, text_hash long, n_shingles long, key string, sig array<long>, bands array<long>")


def _may_match(a: str, b: str, threshold: int) -> Column:
    """Sizes allow the similarity, and the estimate from equal low bits is not far below it.

    Of the positions, a share J + (1 - J) / 2**BITS agrees at similarity J. The bound lies 6 standard deviations below
    what the threshold gives, so a true pair fails once in a billion.
    """
    chance = 1 / (1 << BITS)
    want = threshold / 100 * (1 - chance) + chance
    least = PERMUTATIONS * want - 6 * (PERMUTATIONS * want * (1 - want)) ** 0.5
    differ = F.lit(0)
    for k in range(LONGS):
        x = F.get(f"{a}.sig", F.lit(k)).bitwiseXOR(F.get(f"{b}.sig", F.lit(k)))
        differ = differ + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))
    n, m = F.col(f"{a}.n_shingles"), F.col(f"{b}.n_shingles")
    return (100 * F.least(n, m) >= threshold * F.greatest(n, m)) & (differ <= int(PERMUTATIONS - least))


def _texts(ids: DataFrame, reps: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text of the classes in ids."""
    wanted = reps.join(ids, "id").select("id", F.col("doc_id").alias("d"), F.col("text_hash").alias("t"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    return rows.join(wanted, (F.col("text_hash") == F.col("t")) & F.col("doc_id").eqNullSafe(F.col("d"))).select("id", "text").dropDuplicates(["id"])


def _sets(column: pa.Array, shingle: int) -> Iterator[np.ndarray]:
    for _, _, data, offsets in text_chunks(column):
        yield from shingle_hashes(*word_hashes(data, offsets), shingle)


def _confirmed(pairs: DataFrame, reps: DataFrame, docs: DataFrame, shingle: int, threshold: int, id_col: str, text_col: str) -> DataFrame:
    """Of the pairs (a, b) of class ids those whose full shingle sets reach the threshold."""
    pairs = written(pairs, "pairs")
    ends = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    texts = written(_texts(ends, reps, docs, id_col, text_col), "texts")
    both = skew_join(pairs, texts.select(F.col("id").alias("a"), F.col("text").alias("x")), "a", hot_cells(pairs, "a"))
    both = both.join(texts.select(F.col("id").alias("b"), F.col("text").alias("y")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for step in range(0, len(batch), 256):
                part = batch.slice(step, 256)
                keep = []
                for s, t in zip(*(_sets(part.column(c), shingle) for c in ("x", "y")), strict=True):
                    common = len(np.intersect1d(s, t, assume_unique=True))
                    keep.append(100 * common >= threshold * (len(s) + len(t) - common))
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def common_counts(sets: list[np.ndarray], chunk: int = 2048) -> np.ndarray:
    """Exact sizes of all intersections, from products of 0/1 matrices over the values that two sets or more hold."""
    n = len(sets)
    found = np.zeros((n, n), np.float32)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    _, at, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.cumsum(counts > 1) - 1
    shared = counts[at] > 1
    row, at = row[shared], column[at[shared]]
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    for low in range(0, int(at[-1]) + 1 if len(at) else 0, chunk):
        a, b = np.searchsorted(at, [low, low + chunk])
        m = np.zeros((n, chunk), np.float32)
        m[row[a:b], at[a:b] - low] = 1
        found += m @ m.T
    return found.astype(np.int64)


def _across(loose: DataFrame, sets: DataFrame, threshold: int, block: int, block_shingles: int = 1_000_000) -> DataFrame:
    """Links between different components inside a bucket: a spanning set of them, never all pairs.

    loose: bucket, id, root, and of its bucket: the largest component (``main``), and members and shingles in it (n_main,
    w_main) and outside (n_rest, w_rest). Members in and outside of the largest component are dealt into blocks of about
    ``block`` members, and of no more than about ``block_shingles`` shingles; each two blocks, but not two of the largest
    component, meet in one group, where exact intersections come from matrix products. So a bucket of any size is covered
    in bounded tasks, and a large group of copies costs as often as there are blocks outside of it.
    """
    blocks = lambda n, w: F.ceil(F.greatest(F.col(n) / block, F.col(w) / block_shingles)).cast("int")
    deal = lambda k: F.pmod(F.xxhash64("id", "bucket"), F.greatest(F.col(k), F.lit(1))).cast("int")
    parted = loose.withColumns({"inside": F.col("root") == F.col("main"), "k": blocks("n_main", "w_main"), "m": blocks("n_rest", "w_rest")})
    own = F.when(F.col("inside"), deal("k")).otherwise(F.col("k") + deal("m"))
    others = F.sequence(F.when(F.col("inside"), F.col("k")).otherwise(0), F.col("k") + F.col("m") - 1)
    dealt = parted.withColumn("own", own).withColumn("other", F.explode(others))
    dealt = dealt.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "root").join(sets, "id")

    def run(table: pa.Table) -> pa.Table:
        ids, roots, own_ = (table.column(c).to_numpy() for c in ("id", "root", "own"))
        out: list[tuple[int, int]] = []
        if len(set(roots.tolist())) > 1:
            held = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("shingles")]
            sizes = np.array([len(s) for s in held])
            common = common_counts(held)
            linked = 100 * common >= threshold * (sizes[:, None] + sizes[None, :] - common)
            linked &= roots[:, None] < roots[None, :]
            if table.column("i")[0] != table.column("j")[0]:
                linked &= own_[:, None] != own_[None, :]
            top = {r: r for r in roots.tolist()}
            for x, y in zip(*np.nonzero(linked), strict=True):
                a, b = (_top(top, roots[k].item()) for k in (x, y))
                if a != b:
                    top[a] = b
                    out.append((ids[x].item(), ids[y].item()))
        return pa.table([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], ["a", "b"])

    return dealt.groupBy("bucket", "i", "j").applyInArrow(run, "a long, b long")


def _packed_sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for step in range(0, len(batch), 1024):
                part = batch.slice(step, 1024)
                held = [s.tobytes() for s in _sets(part.column("text"), shingle)]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(held, pa.binary())], ["id", "shingles"])

    return run


def _top(top: dict[int, int], x: int) -> int:
    while top[x] != x:
        top[x] = top[top[x]]
        x = top[x]
    return x


def near_duplicates(docs: DataFrame, shingle: int = 5, threshold: int = 80, id_col: str = "doc_id", text_col: str = "text", block: int = 1024) -> DataFrame:
    """Groups rows whose texts are linked: 100 * common shingles >= threshold * shingles of either.

    Equal shingle sets are one class; a class is shown by one row. Classes that share a band of minima are candidates.
    In each bucket all classes are paired with one of them only, that which shares most buckets; pairs that sizes and
    packed low bits allow are confirmed on full sets, and components are formed. A bucket that still holds several
    components is gone through block by block for links between them, so no link that matters is lost, and no bucket of
    copies is expanded into pairs.

    Returns for every row doc_id, text_hash (xxhash64 of the text), n_shingles, component_id (the smallest doc_id of the
    component, its own included) and kept (doc_id = component_id). Words: ASCII white space parts them, A-Z read as a-z.
    Texts with fewer words than a shingle are one shingle. Rows without words, null texts included, are linked with
    nothing and keep their own id. Null ids: such a row takes the smallest id of its component and is kept only if there
    is none. Repeated rows get the same values. An empty table gives an empty result; other columns are ignored.
    """
    found = written(sketches(docs, shingle, id_col, text_col), "sketches")
    full = found.where(F.col("key").isNotNull())
    first = full.groupBy("key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("m"), F.min("n_shingles").alias("n_shingles"))
    shown = first.select("key", F.col("m.doc_id").alias("doc_id"), F.col("m.text_hash").alias("text_hash"), "n_shingles")
    own = full.select(F.col("key").alias("k"), F.col("doc_id").alias("d"), F.col("text_hash").alias("t"), "sig", "bands")
    same = (F.col("key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t"))
    reps = written(
        shown.join(own, same).dropDuplicates(["key"]).select("key", "doc_id", "text_hash", "n_shingles", "sig", "bands").withColumn("id", F.monotonically_increasing_id()),
        "classes",
    )
    placed = reps.select("id", F.explode("bands").alias("bucket"))
    crowded = placed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    hot = written(hot_cells(placed, "bucket"), "hot")
    together = written(skew_join(placed, crowded, "bucket", hot), "together")
    # The row that shares buckets with most others is likeliest to be what the others were copied from.
    degree = together.groupBy("id").agg(F.sum("n").alias("degree"))
    centre = together.join(degree, "id").groupBy("bucket").agg(F.max(F.struct("degree", (-F.col("id")).alias("less"))).alias("m")).select("bucket", (-F.col("m.less")).alias("first"))
    members = written(skew_join(together, centre, "bucket", hot), "members")
    side = lambda key, name: reps.select(F.col("id").alias(key), F.struct("sig", "n_shingles").alias(name))
    stars = members.where(F.col("id") != F.col("first")).select(F.col("first").alias("a"), F.col("id").alias("b")).distinct()
    stars = skew_join(stars, side("a", "x"), "a", hot_cells(stars, "a")).join(side("b", "y"), "b").where(_may_match("x", "y", threshold)).select("a", "b")
    links = written(_confirmed(stars, reps, docs, shingle, threshold, id_col, text_col), "links")
    roots = written(components(links), "roots")

    rest = members.where("n > 2").join(reps.select("id", "n_shingles"), "id").join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    of_root = rest.groupBy("bucket", "root").agg(F.count("*").alias("c"), F.sum("n_shingles").alias("w"))
    of_bucket = of_root.groupBy("bucket").agg(F.max(F.struct("c", "root", "w")).alias("big"), F.sum("c").alias("c"), F.sum("w").alias("w"), F.count("*").alias("roots"))
    mixed = of_bucket.where("roots > 1").select(
        "bucket", F.col("big.root").alias("main"), F.col("big.c").alias("n_main"), F.col("big.w").alias("w_main"), (F.col("c") - F.col("big.c")).alias("n_rest"), (F.col("w") - F.col("big.w")).alias("w_rest")
    )
    loose = written(skew_join(rest.where(F.col("id") != F.col("first")).select("bucket", "id", "root"), mixed, "bucket", hot), "loose")
    sets = _texts(loose.select("id").distinct(), reps, docs, id_col, text_col).mapInArrow(_packed_sets(shingle), "id long, shingles binary")
    extra = written(_across(loose, written(sets, "sets"), threshold, block), "links")
    if extra.limit(1).count():
        roots = written(components(links.unionByName(extra)), "roots")

    named = reps.select("id", "key", "doc_id").join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    by_key = named.join(least, "root").select("key", "component_id")
    columns = ["doc_id", "text_hash", "n_shingles", "component_id"]
    empty = found.where(F.col("key").isNull()).withColumn("component_id", F.col("doc_id")).select(*columns)
    return full.join(by_key, "key").select(*columns).unionByName(empty).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
