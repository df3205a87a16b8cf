"""Statistics of whole texts for quality rules, from their bytes, many documents at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import release
from .textbytes import slices, text_buffers, word_hashes, words

#: Names of the statistics, in the order of the rows of `statistics`.
STATS = (
    "n_chars", "n_words", "mean_word", "upper", "digits", "symbols", "marks", "pipes", "stops", "breaks", "non_ascii",
    "distinct_words", "top_word", "repeated_pairs", "repeated_halves", "marked_words", "capital_words", "vowels",
)


def _table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


_UPPER, _DIGIT = _table(bytes(range(65, 91))), _table(b"0123456789")
_SYMBOL, _MARK, _PIPE = _table(b"#$%&*@^~<>{}[]\\/=+_"), _table(b"!?"), _table(b"|")
_STOP, _BREAK, _VOWEL = _table(b".,;:"), _table(b"\n"), _table(b"aeiouAEIOU")
_CONTINUES, _HIGH = _table(bytes(range(128, 192))), _table(bytes(range(192, 256)))
_LETTERISH = _table(bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256)))


def _sums(mask: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    run = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=run[1:])
    return run[bounds[1:]] - run[bounds[:-1]]


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of STATS per document; all zero for an empty text."""
    base = int(offsets[0])
    raw = data[base : int(offsets[-1])]
    bounds = offsets - base
    lower, starts, ends, firsts = words(data, offsets)
    chars = _sums(~_CONTINUES[raw], bounds)
    n_words = np.diff(firsts)
    by = np.maximum(chars, 1)
    per_word = np.maximum(n_words, 1)
    ratio = lambda t: _sums(t[raw], bounds) / by
    h = word_hashes(lower, starts, ends)
    last = raw[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    first = raw[starts] if len(starts) else np.zeros(0, np.uint8)
    marked = ~_LETTERISH[last] & ~_STOP[last]
    capital = _UPPER[first] & _UPPER[np.minimum(raw[np.minimum(starts + 1, max(len(raw) - 1, 0))], 255)] if len(starts) else np.zeros(0, bool)
    distinct, top, pairs, halves = (np.zeros(len(chars)) for _ in range(4))
    for i, (a, b) in enumerate(zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True)):
        if b == a:
            continue
        own = h[a:b]
        _, counts = np.unique(own, return_counts=True)
        distinct[i], top[i] = len(counts) / (b - a), counts.max() / (b - a)
        if b - a > 3:
            three = own[:-3] * np.uint64(3) + own[1:-2] * np.uint64(5) + own[2:-1] * np.uint64(7) + own[3:] * np.uint64(11)
            _, c = np.unique(three, return_counts=True)
            pairs[i] = 1 - len(c) / len(three)
            halves[i] = c.max() / len(three)
    word_bytes = _sums_of(ends - starts, firsts)
    rows = [
        chars, n_words, word_bytes / per_word, ratio(_UPPER), ratio(_DIGIT), ratio(_SYMBOL), ratio(_MARK), ratio(_PIPE), ratio(_STOP), ratio(_BREAK), ratio(_HIGH),
        distinct, top, pairs, halves, _sums_of(marked, firsts) / per_word, _sums_of(capital, firsts) / per_word, ratio(_VOWEL),
    ]
    return np.stack([np.asarray(r, np.float64) for r in rows], 1)


def _sums_of(values: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    run = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=run[1:])
    return run[firsts[1:]] - run[firsts[:-1]]


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    for batch in batches:
        data, offsets = text_buffers(batch.column("text"))
        found = [statistics(data, offsets[lo : hi + 1]) for lo, hi in slices(offsets)]
        table = np.concatenate(found) if found else np.zeros((0, len(STATS)))
        yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(table[:, i]) for i in range(len(STATS)))], names=["id", *STATS])


def with_statistics(docs: DataFrame, carry: Column, text_col: str = "text") -> DataFrame:
    """`id` (the carried column, of any type) and STATS (double) of every whole text; null texts count as empty."""
    rows = docs.select(carry.alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_run, f"id {kind}, " + ", ".join(f"{s} double" for s in STATS))
