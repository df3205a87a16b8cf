"""Vectorised work on the UTF-8 buffers of Arrow string columns.

Texts stay in one byte buffer with offsets: lower-casing, word bounds, word hashes and
shingle hashes are computed for a slice of many documents at once, without a Python
object per word. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SHINGLE_WORDS = 5
#: Bytes of text worked on at a time; it bounds a worker's memory, not the length of a text.
SLICE_BYTES = 1 << 21

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        tables = []
        for base in (_BASE, _INVERSE):
            t = np.full(size, base, np.uint64)
            t[0] = 1
            tables.append(np.cumprod(t, dtype=np.uint64))
        if size > 4 * SLICE_BYTES:  # a very long text: used once, not kept
            return tables[0], tables[1]
        _powers = (tables[0], tables[1])
    return _powers


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the offsets (length + 1) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of documents of about `limit` bytes together; a longer document stands alone, whole."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(n, max(last, first + 1))
        yield first, last
        first = last


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, starts and ends of their words, and per document the first word's index (length + 1)."""
    base, end = int(offsets[0]), int(offsets[-1])
    lower = _LOWER[data[base:end]]
    solid = ~_BLANK[lower]
    cut = np.zeros(end - base + 1, bool)
    cut[offsets - base] = True
    before = np.empty_like(solid)
    before[:1] = False
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | cut[:-1]))
    after = np.empty_like(solid)
    after[-1:] = False
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | cut[1:])) + 1
    return lower, starts, ends, np.searchsorted(starts, offsets - base)


def word_hashes(lower: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of words, from differences of one running polynomial over the slice."""
    up, down = _power_tables(len(lower) + 1)
    run = np.zeros(len(lower) + 1, np.uint64)
    np.cumsum((lower.astype(np.uint64) + np.uint64(1)) * up[: len(lower)], out=run[1:])
    return mix((run[ends] - run[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingles(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE_WORDS) -> Iterator[np.ndarray]:
    """Per document the sorted distinct hashes of its k-word shingles; fewer words are one shingle, none are none."""
    lower, starts, ends, bounds = words(data, offsets)
    h = word_hashes(lower, starts, ends)
    n = len(h)
    rolled = np.zeros(max(n - k + 1, 0), np.uint64)
    for i in range(k):
        rolled = (rolled + h[i : i + len(rolled)]) * _BASE
    rolled = mix(rolled)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= k:
            yield np.unique(rolled[a : b - k + 1])
        elif b > a:
            x = np.uint64(b - a)
            for y in h[a:b]:
                x = mix(np.array([(x ^ y)], np.uint64) * _INVERSE)[0]
            yield np.array([x], np.uint64)
        else:
            yield np.zeros(0, np.uint64)
