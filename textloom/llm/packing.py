"""Packing of token sequences by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import written
from textloom.operators.mixture import with_position


def karmarkar_karp(sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Splits sizes into k windows of nearly equal sums: (window of each item, sum of each window).

    A partial partition is its nonzero sums in falling order; absent ones are 0. The two partitions of the largest
    spread are merged again and again, the largest sums of one onto the smallest of the other, so their imbalances
    cancel. A window's items hang in a binary tree: merging two windows makes one node.
    """
    n = len(sizes)
    if k <= 1 or not n:
        return np.zeros(n, np.int64), np.array([sizes.sum()] if n else [0])
    left, right = np.zeros(n, np.int64), np.zeros(n, np.int64)  # of node n + i; nodes below n are items
    made = 0
    heap = [(-int(s), i, np.array([s], np.int64), np.array([i], np.int64)) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    tie = n
    while len(heap) > 1:
        _, _, a, a_at = heapq.heappop(heap)
        _, _, b, b_at = heap[0]
        if len(b) > len(a):
            a, a_at, b, b_at = b, b_at, a, a_at
        over = len(a) + len(b) - k
        if over <= 0:
            sums, at = np.concatenate([a, b]), np.concatenate([a_at, b_at])
        else:
            # the last `over` sums of a, falling, stand against the last `over` of b in rising order
            own = len(a) - over
            met, met_at = b[::-1][:over], b_at[::-1][:over]
            nodes = np.arange(n + made, n + made + over)
            left[made : made + over], right[made : made + over] = a_at[own:], met_at
            made += over
            sums = np.concatenate([a[:own], a[own:] + met, b[: len(b) - over]])
            at = np.concatenate([a_at[:own], nodes, b_at[: len(b) - over]])
        order = np.argsort(-sums, kind="stable")
        sums, at = sums[order], at[order]
        low = int(sums[-1]) if len(sums) == k else 0
        heapq.heapreplace(heap, (low - int(sums[0]), tie, sums, at))
        tie += 1
    _, _, sums, at = heap[0]
    window = np.full(n + made, -1, np.int64)
    window[at] = np.arange(len(at))
    for i in range(made - 1, -1, -1):
        window[left[i]] = window[right[i]] = window[n + i]
    return window[:n], sums


def pack(sizes: np.ndarray, capacity: int, most: int | None = None) -> np.ndarray | None:
    """Window of each item, none above capacity; the count of windows rises from the least possible until that holds.

    With ``most``, None if that many windows do not hold all either: this is looked at first.
    """
    k = max(1, -(-int(sizes.sum()) // capacity))
    loosest = None
    if most is not None and most > k:
        loosest, sums = karmarkar_karp(sizes, most)
        if sums.max(initial=0) > capacity:
            return None
    while loosest is None or k < most:
        window, sums = karmarkar_karp(sizes, k)
        if sums.max(initial=0) <= capacity:
            return window
        if k == most:
            return None
        k += max(1, k // 250)
    return loosest


def fill(lengths: np.ndarray, capacity: int, least: float = 0.98, smallest: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(item, start, length, window) of pieces of items no longer than capacity, packed into windows.

    Items are packed whole. Only if that leaves more than a share of 1 - ``least`` empty, although fewer windows would
    hold all, items longer than half the capacity are cut there, then those longer than a quarter, and so on.
    """
    limit = capacity
    while True:
        n = np.maximum(1, -(-lengths // limit))
        item = np.repeat(np.arange(len(lengths)), n)
        start = (np.arange(len(item)) - np.repeat(np.cumsum(n) - n, n)) * limit
        length = np.minimum(limit, lengths[item] - start)
        total = int(lengths.sum())
        most = max(-(-total // capacity), int(total / (least * capacity)))
        window = pack(length, capacity, most if limit > smallest else None)
        if window is not None:
            return item, start, length, window
        limit //= 2


#: A run of blanks that is one token too long for the fast library.
_LONG_SPACE = re.compile(r"\s{20000}")
_BREAK = re.compile(r"(?<=\S)(?=\s)")


class Encoder:
    """Byte-level BPE ids of a text, equal to those of the library ``tokenizers`` and its JSON file in every case.

    Ranks and JSON hold one vocabulary. The ranks' library is four times faster, but fails on very long texts and on very
    long runs of blanks. The pattern's pre-tokens are contractions, runs of letters, of numbers and of other signs, each
    with at most one blank before it, and runs of blanks; so none has a blank after another character, and a text cut before a
    blank that follows one has the same pre-tokens, whatever of Unicode's blanks it is (tests go through all of them).
    Texts with 20,000 blanks in a row take ``tokenizers``.
    """

    def __init__(self, ranks_path: str, json_path: str, pattern: str) -> None:
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.json_path = json_path

    @lru_cache(maxsize=1)  # noqa: B019
    def slow(self):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(self.json_path)
        t.encode_special_tokens = True
        return t

    def ids(self, text: str, chunk: int = 100_000) -> np.ndarray:
        if len(text) <= chunk:
            return np.array(self.fast.encode_ordinary(text), np.uint32)
        if _LONG_SPACE.search(text):
            return np.array(self.slow().encode(text, add_special_tokens=False).ids, np.uint32)
        parts, at = [], 0
        while at < len(text):
            m = _BREAK.search(text, at + chunk) if len(text) - at > chunk else None
            end = m.start() if m else len(text)
            parts.append(np.array(self.fast.encode_ordinary(text[at:end]), np.uint32))
            at = end
        return np.concatenate(parts)


@lru_cache(maxsize=2)
def encoder(ranks_path: str, json_path: str, pattern: str) -> Encoder:
    return Encoder(ranks_path, json_path, pattern)


def squeezed(ids: np.ndarray) -> bytes:
    """Unsigned 32-bit ids by planes of bytes, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def opened(code: bytes) -> bytes:
    """The ids, lowest byte first."""
    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(code), np.uint8).reshape(4, -1).T).tobytes()


def token_pieces(docs: DataFrame, paths: tuple[str, str, str], capacity: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length, code, doc_tokens: as many whole sequences as each document's ids and end id fill, and what is left.

    code: the ids compressed (``squeezed``), a third of their size where they are stored and shuffled.
    """
    kept = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = dict(kept.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(*paths)
        for batch in batches:
            # In steps, so that what leaves at once is some million ids, or one longer text.
            rows, out, held, size = [], [], [], 0
            for i, x in enumerate(batch.column("text")):
                ids = np.append(enc.ids(x.as_py() or ""), np.uint32(end_id)).astype("<u4")
                for start in range(0, len(ids), capacity):
                    part = ids[start : start + capacity]
                    rows.append(i)
                    out.append((start, len(part), len(ids)))
                    held.append(squeezed(part))
                size += len(ids)
                if size > 2_000_000 or i + 1 == len(batch):
                    start, length, tokens = np.array(out, np.int64).reshape(-1, 3).T
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(start), pa.array(length), pa.array(held, pa.binary()), pa.array(tokens)],
                        ["doc_id", "start", "length", "code", "doc_tokens"],
                    )
                    rows, out, held, size = [], [], [], 0

    return kept.mapInArrow(run, f"doc_id {id_type}, start long, length long, code binary, doc_tokens long")


def pack_documents(
    docs: DataFrame,
    paths: tuple[str, str, str],
    capacity: int = 2048,
    group: int = 4096,
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Packs the tokens of all documents into sequences of at most ``capacity`` tokens; a row for each piece.

    ``paths``: the tokenizer's rank file, its JSON file, its pre-token pattern. A document's ids end with ``end_id``. As
    many whole sequences as it fills are sequences of their own. What is left of each document is ordered by a hash of id
    and ids, and each ``group`` of neighbours in that order is split by Karmarkar-Karp differencing into the fewest
    windows; the count rises while a window exceeds the capacity. Remainders stay whole unless that wastes room
    (``fill``). So no task holds more than ``group`` remainders. Sequences are padded to ``capacity``, or not at all where
    their length is a power of two.

    Returns doc_id, start, length, ids (binary: unsigned 32-bit, lowest byte first), doc_tokens, sequence_id, offset,
    padded_to. Sequence ids do not depend on how the rows are partitioned. A null text is an empty one and has the end
    id alone. Null ids and repeated rows are documents like any other; equal rows may change places with each other. An
    empty table gives an empty result; other columns are ignored.
    """
    pieces = token_pieces(docs, paths, capacity, end_id, id_col, text_col)
    pieces = pieces.withColumns({"h": F.xxhash64("doc_id", "start", "code"), "row": F.monotonically_increasing_id(), "whole": F.col("length") == capacity})
    pieces = written(pieces, "pack-pieces")
    # Lengths alone are ordered and packed; the ids are shuffled once, when their places are known.
    placed = with_position(pieces.select("whole", "h", "doc_id", "start", "row", "length"), "whole", "h", "doc_id", "start", "row")
    id_type = dict(pieces.dtypes)["doc_id"]
    found = ["row", "cut", "n", "sequence_id", "offset", "padded_to"]

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("pos")
        item, start, length, window = fill(table.column("length").to_numpy(), capacity)
        order = np.lexsort((start, item, window))
        item, start, length, window = item[order], start[order], length[order], window[order]
        sums = np.bincount(window, length).astype(np.int64)
        before = np.cumsum(length) - length
        offset = before - before[np.searchsorted(window, window)]
        padded = np.where(sums & (sums - 1), capacity, sums)[window]
        sequence = table.column("g")[0].as_py() * (1 << 32) + window
        return pa.table([pa.array(x) for x in (table.column("row").to_numpy()[item], start, length, sequence, offset, padded)], found)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [opened(c)[4 * a : 4 * (a + n)] for c, a, n in zip(*(batch.column(x).to_pylist() for x in ("code", "cut", "n")), strict=True)]
            rest = [batch.column(x) for x in ("doc_id", "start", "n", "doc_tokens", "sequence_id", "offset", "padded_to")]
            rest.insert(3, pa.array(ids, pa.binary()))
            yield pa.RecordBatch.from_arrays(rest, columns)

    columns = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "padded_to"]
    rest = placed.where(~F.col("whole")).select("row", "length", "pos", F.floor(F.col("pos") / group).alias("g"))
    packed = rest.groupBy("g").applyInArrow(run, ", ".join(f"{x} long" for x in found))
    zero = F.lit(0).cast("long")
    whole = placed.where("whole").select("row", zero.alias("cut"), F.col("length").alias("n"), (F.col("pos") + F.lit(1 << 62)).alias("sequence_id"), zero.alias("offset"), F.lit(capacity).cast("long").alias("padded_to"))
    both = pieces.select("row", "doc_id", "start", "code", "doc_tokens").join(packed.unionByName(whole), "row").withColumn("start", F.col("start") + F.col("cut"))
    schema = f"doc_id {id_type}, " + ", ".join(f"{x} {'binary' if x == 'ids' else 'long'}" for x in columns[1:])
    return both.mapInArrow(cut, schema)
