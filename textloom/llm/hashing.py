"""Word hashes of whole columns of texts in numpy: no Python step for each word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (constants of the public splitmix64)."""
    x = x + _U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(256, dtype=_U) + _U(1 << 40))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE[_SPACE] = 0
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_place = mix(np.arange(1 << 12, dtype=_U)) | _U(1)


def _places(n: int) -> np.ndarray:
    global _place
    if n > len(_place):
        _place = mix(np.arange(2 * n, dtype=_U)) | _U(1)
    return _place


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts that lie side by side in data, and where each text's words begin (one entry more).

    A-Z count as a-z; words are parted by ASCII white space and by the bounds of texts. A word's hash is the sum of its
    bytes' random numbers, each times an odd random number of its place, mixed at the end.
    """
    none = np.zeros(0, _U)
    if not len(data):
        return none, np.zeros(len(offsets), np.int64)
    data = _LOWER[data]
    space = _SPACE[data]
    start = ~space
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    fresh = start[inner]
    start[1:] &= space[:-1]
    start[inner] = fresh
    starts = np.flatnonzero(start)
    if not len(starts):
        return none, np.zeros(len(offsets), np.int64)
    lengths = np.diff(starts, append=len(data))
    lengths[0] += starts[0]
    place = np.arange(len(data), dtype=np.int64) - np.repeat(starts, lengths)
    place[: starts[0]] = 0
    values = _BYTE[data] * _places(int(lengths.max()) + 1)[place]
    return mix(np.add.reduceat(values, starts)), np.searchsorted(starts, offsets)


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its n-word shingles; of fewer words the whole text is one shingle."""
    every = _combined(words, n)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= n:
            yield np.unique(every[a : b - n + 1])
        else:
            yield _combined(words[a:b], b - a) if b > a else words[:0]


def _combined(words: np.ndarray, n: int) -> np.ndarray:
    count = len(words) - n + 1
    if count <= 0:
        return words[:0]
    total = np.full(count, _U(n))
    for k in range(n):
        total = mix(total) * _U(0x9E3779B97F4A7C15) + words[k : k + count]
    return mix(total)


def text_chunks(column: pa.Array, limit: int = 2_000_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of at most ``limit`` bytes, or of one longer row. Nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    if not wide and not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    n = len(column)
    if not n:
        return
    _, offset_buffer, data_buffer = column.buffers()
    offsets = np.frombuffer(offset_buffer, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data_buffer, np.uint8) if data_buffer is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end
