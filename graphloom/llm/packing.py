"""Packing: pieces of documents into sequences of a fixed capacity by multiway differencing.

Full windows of a document are sequences as they are. What is left of each document is
pooled whole; a pool of a bounded number of ids is divided by Karmarkar-Karp multiway
differencing: partial partitions whose imbalances oppose each other are merged, largest
first, until one partition of near-equal windows is left. The number of windows starts at
the least possible and rises while a window exceeds the capacity; what then still exceeds it
is cut off and fills the emptiest windows. Pools never leave their task, so nothing is shuffled.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches
from .tokens import REMEMBERED, encoder, gathered, portions, vocabulary_path

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def differencing(sizes: list[int], ways: int) -> list[list[int]]:
    """The items of `ways` near-equal windows (Karmarkar-Karp).

    A partial partition lists its non-empty windows in falling order of their sums above the
    least one. The two partitions with the largest spread are merged, the large sums of one
    with the small sums of the other. A window is one integer, its sum above the node that
    holds its items: an item, or a pair of nodes that were merged.
    """
    n = len(sizes)
    if ways == 1:
        return [list(range(n))]
    bits = (2 * n).bit_length()
    node = (1 << bits) - 1
    pairs: list[tuple[int, int]] = []
    heap = [(-size, i, [size << bits | i]) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    count = n
    while len(heap) > 1:
        x = heapq.heappop(heap)[2]
        y = heap[0][2]
        over = len(x) + len(y) - ways
        if over <= 0:
            merged = x + y
        else:
            merged = x[:-over] + y[: len(y) - over]
            for a, b in zip(reversed(x[-over:]), y[len(y) - over :], strict=True):
                merged.append((a & ~node) + (b & ~node) | (n + len(pairs)))
                pairs.append((a & node, b & node))
        merged.sort(reverse=True)
        if len(merged) == ways and (low := merged[-1] & ~node):
            merged = [w - low for w in merged]
        heapq.heapreplace(heap, (-(merged[0] >> bits), count, merged))
        count += 1
    done: list[list[int]] = [[] for _ in range(ways)]
    for items, window in zip(done, heap[0][2] if heap else [], strict=False):
        open_ = [window & node]
        while open_:
            k = open_.pop()
            if k < n:
                items.append(k)
            else:
                open_ += pairs[k - n]
    return done


def windows_of(sizes: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Near-equal windows of at most `capacity`, as pieces (item, start in it, length).

    The number of windows starts at the least possible and rises by one at a time while
    differencing leaves a window above the capacity, until the windows are a 64th more, once at
    least, but never so far that a quarter is padding. Only what doesn't fit even then is cut:
    the end of the longest item of a window that is too full goes to the windows with most room.
    """
    total = sum(sizes)
    least = max(1, -(-total // capacity))
    for ways in range(least, least + max(1, least // 64) + 1):
        if ways > least and (ways * capacity - total) * 4 > ways * capacity:
            break
        found = differencing(sizes, ways)
        if max(sum(sizes[i] for i in w) for w in found) <= capacity:
            break
    windows = [[(i, 0, sizes[i]) for i in w] for w in found]
    loose: list[tuple[int, int, int]] = []
    rooms: list[tuple[int, int]] = []
    for k, w in enumerate(windows):
        over = sum(n for _, _, n in w) - capacity
        w.sort(key=lambda x: x[2])
        while over > 0:
            i, a, n = w.pop()
            cut = min(over, n)
            loose.append((i, a + n - cut, cut))
            if n > cut:
                w.append((i, a, n - cut))
            over -= cut
        if over < 0:
            rooms.append((over, k))
    heapq.heapify(rooms)
    for i, a, n in sorted(loose, key=lambda x: (-x[2], x)):
        while n:
            room, k = rooms[0]
            put = min(n, -room)
            windows[k].append((i, a, put))
            a, n = a + put, n - put
            if room + put:
                heapq.heapreplace(rooms, (room + put, k))
            else:
                heapq.heappop(rooms)
    return [w for w in windows if w]


def _pack(vocabulary: str, capacity: int, end_id: int, pool_ids: int, remembered: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode_all = encoder(vocabulary, remembered).encode_all
        sequence = TaskContext.get().partitionId() << 36
        rows: list[tuple] = []
        pool: list[tuple] = []  # document, start, ids, ids of the document
        held = 0

        def drain() -> None:
            nonlocal sequence, held
            for window in windows_of([len(x[2]) for x in pool], capacity):
                at = 0
                for i, a, n in sorted(window, key=lambda x: (-x[2], x)):
                    doc, start, ids, whole = pool[i]
                    rows.append((doc, start + a, n, zlib.crc32(ids[a : a + n]), whole, sequence, at))
                    at += n
                sequence += 1
            pool.clear()
            held = 0

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) if rows else [()] * 7
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for batch in gathered(batches):
            for portion in portions(batch, 1):
                ids, sizes = encode_all(portion.column(1), end_id)
                first = 0
                for doc, n in zip(portion.column(0).to_pylist(), sizes.tolist(), strict=True):
                    own = ids[first : first + n]
                    first += n
                    full = n // capacity * capacity
                    for a in range(0, full, capacity):
                        rows.append((doc, a, capacity, zlib.crc32(own[a : a + capacity]), n, sequence, 0))
                        sequence += 1
                    if n > full:
                        pool.append((doc, full, own[full:].copy(), n))
                        held += n - full
                    if held >= pool_ids:
                        drain()
                yield batch_of()
        if pool:
            drain()
        yield batch_of()

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, capacity: int = 2048, end_id: int = 1, pool_ids: int = 256 * 2048, remembered: int = REMEMBERED) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is the ids of its whole text (null: empty) and the end id; every id lies in
    exactly one piece. Repeated rows are repeated documents; a null id stays null; other
    columns are not read; an empty table gives no rows. `remembered` bounds the bytes that a
    worker spends on pieces it has met.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_pack(vocabulary or vocabulary_path(), capacity, end_id, pool_ids, remembered), SCHEMA)


def padding(sequence_length: int, capacity: int = 2048) -> int:
    """Ids of padding of a sequence: none at a power of two, else up to the capacity."""
    return 0 if sequence_length & (sequence_length - 1) == 0 else capacity - sequence_length
