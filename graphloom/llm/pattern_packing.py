"""Best-fit packing by length patterns and non-negative least squares.

The number of sequences depends on the documents' lengths alone, so the whole plan is made
from the histogram of lengths, which has at most `capacity` rows whatever the corpus holds.
Lengths fall into classes; patterns of up to four documents whose classes nearly fill a
sequence are enumerated, and non-negative least squares, in which a long class weighs more,
fits how often each repeats. A share of these counts is rounded down and dealt; where a
longer document is left over that fits in place of a pattern's longest, it takes its place.
Best fit in falling order of length packs what is left into the patterns' gaps and into
sequences of its own, many equal ones at a time.

A plan is a table of runs: of a length's documents, those from number `lo` on lie `per` to a
sequence, from sequence `base` and offset `at` on. Each document gets its number within its
length from counts of the tasks that encoded it, so documents of a length never meet.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import settle, small_batches
from .tokens import REMEMBERED, portions, vocabulary_path
from .word_tokens import word_encoder

#: Classes of lengths, documents of a pattern, and steps of a fit, after which the rest is packed as residual.
CLASSES, PATTERN_DOCS, FIT_STEPS = 128, 4, 600
#: Room that a pattern may leave, as a share of the capacity.
SLACK = 1 / 64
#: Share of a fitted count that is dealt by its pattern. The rest of every length stays for best fit, which needs partners to choose from.
DEALT = 1 / 2
#: Bytes of text that are encoded together: the more, the fewer pieces are looked up again.
PORTION = 4 << 20


def classes_of(histogram: dict[int, int], capacity: int, most: int = CLASSES) -> list[list[int]]:
    """Lengths in classes, rising: each length its own where there are few, else runs of equal width."""
    lengths = sorted(x for x, n in histogram.items() if n)
    if len(lengths) <= most:
        return [[x] for x in lengths]
    out: dict[int, list[int]] = {}
    for x in lengths:
        out.setdefault((x * most - 1) // capacity, []).append(x)
    return list(out.values())


def patterns(means: np.ndarray, tops: np.ndarray, capacity: int, slack: float, most: int = PATTERN_DOCS) -> np.ndarray:
    """Rising tuples of one to `most` classes, each with the largest last class that fits; -1 fills a row.

    Documents of a pattern are dealt in opposite orders of length to slots one and two, and to
    three and four, so two slots count by the means of their classes, a single one by its longest.
    """
    n = len(means)
    head, found = np.zeros((1, 0), np.int64), []
    for k in range(most):
        room = capacity - means[head].sum(1)
        size = means if k % 2 else tops
        last = np.searchsorted(size, room + 1e-9, "right") - 1
        whole = np.column_stack([head, last])
        low = head[:, -1] if k else np.zeros(len(head), np.int64)
        good = (last >= low) & (last >= 0)
        good[good] = room[good] - size[last[good]] <= slack * capacity
        found.append(np.pad(whole[good], ((0, 0), (0, most - 1 - k)), constant_values=-1))
        # every class that may stand in this slot of a longer pattern
        low = np.repeat(head, n, 0)
        c = np.tile(np.arange(n), len(head))
        keep = c >= (low[:, -1] if k else 0)
        head = np.column_stack([low, c])[keep]
        head = head[means[head].sum(1) + means[head[:, -1]] <= capacity]
    return np.concatenate(found)


def non_negative_least_squares(columns: np.ndarray, b: np.ndarray, weights: np.ndarray, steps: int = FIT_STEPS) -> np.ndarray:
    """x >= 0 with the least |weights * (a x - b)| (active sets after Lawson and Hanson); a column of `a` counts the rows that its entries of `columns` name, -1 none."""
    n, rows = len(columns), len(b)
    x, free, shut = np.zeros(n), np.zeros(n, bool), np.zeros(n, bool)
    scale = float(np.abs(b).max(initial=0.0)) or 1.0
    b = b / scale * weights

    def dense(at: np.ndarray) -> np.ndarray:
        a = np.zeros((rows + 1, len(at)))
        np.add.at(a, (columns[at], np.arange(len(at))[:, None]), 1)  # -1 is the last row
        return a[:rows] * weights[:, None]

    for _ in range(steps if n else 0):
        at = np.flatnonzero(free)
        rest = np.append((b - dense(at) @ x[at]) * weights, 0.0)
        slope = np.where(free | shut, -np.inf, rest[columns].sum(1))
        best = int(slope.argmax())
        if slope[best] <= 1e-12:
            break
        free[best] = True
        while free.any():
            at = np.flatnonzero(free)
            z = np.linalg.lstsq(dense(at), b, rcond=None)[0]
            if (z > 0).all():
                x[:] = 0
                x[at] = z
                break
            bad = z <= 0
            x[at] += (x[at][bad] / np.maximum(x[at][bad] - z[bad], 1e-300)).min() * (z - x[at])
            free[at[x[at] <= 1e-12]] = False
            x[~free] = 0
        if free[best]:
            shut[:] = False
        else:  # it came and went: no gain from it within the precision
            shut[best] = True
    return x * scale


def fitted(histogram: dict[int, int], capacity: int, classes: int = CLASSES) -> list[tuple[list[list[int]], int]]:
    """Patterns (the lengths of each slot's class) and how often each repeats; together they use no more of a class than there is."""
    groups = classes_of(histogram, capacity, classes)
    if not groups:
        return []
    there = np.array([sum(histogram[x] for x in g) for g in groups], np.float64)
    means = np.array([sum(x * histogram[x] for x in g) for g in groups]) / there
    found = patterns(means, np.array([g[-1] for g in groups], np.float64), capacity, SLACK)
    x = non_negative_least_squares(found, there, means / capacity)
    left = there.astype(np.int64)
    out = []
    for j in np.argsort(-x, kind="stable")[: np.count_nonzero(x >= 1)].tolist():
        used = [c for c in found[j].tolist() if c >= 0]
        n = min([int(x[j] * DEALT + 1e-6), *(int(left[c]) // used.count(c) for c in set(used))])
        if n > 0:
            out.append(([groups[c] for c in used], n))
            for c in used:
                left[c] -= n
    return out


Bins = list[tuple[tuple[tuple[int, int], ...], int]]


def packed_bins(histogram: dict[int, int], capacity: int, classes: int = CLASSES) -> Bins:
    """Kinds of sequences ((length, documents of it), ...) and how many there are of each; every document of the histogram lies in one."""
    left = {x: n for x, n in histogram.items() if n}
    there = sum(1 << x for x in left)  # a bit for each length of which there are some

    def add(length: int, n: int) -> None:
        nonlocal there
        left[length] += n
        there = there | 1 << length if left[length] else there & ~(1 << length)

    def taken(lengths: list[int], n: int, longest_first: bool) -> list[list[int]]:
        """n documents of a class, spread over its lengths as they are, as runs [length, how many]."""
        out, total, met, got = [], sum(left[x] for x in lengths), 0, 0
        for x in reversed(lengths) if longest_first else lengths:
            met += left[x]
            some = met * n // total - got
            if some:
                out.append([x, some])
                add(x, -some)
                got += some
        return out

    # sequences of a kind by the room they have; a bit of `rooms` says that there are some
    open_: dict[int, list[tuple[tuple[tuple[int, int], ...], int]]] = {}
    rooms = 0

    def put(kind: tuple[tuple[int, int], ...], n: int, room: int) -> None:
        nonlocal rooms
        open_.setdefault(room, []).append((kind, n))
        rooms |= 1 << room

    dealt: list[tuple[list[int], int]] = []
    for pattern, n in fitted(left, capacity, classes):
        slots = [taken(lengths, n, i % 2 == 0) for i, lengths in enumerate(pattern)]
        while n:
            some = min(s[0][1] for s in slots)
            dealt.append(([s[0][0] for s in slots], some))
            n -= some
            for s in slots:
                s[0][1] -= some
                if not s[0][1]:
                    s.pop(0)
    for lengths, n in [x for x in dealt if sum(x[0]) > capacity]:  # they don't fit after all
        for x in lengths:
            add(x, n)
    for lengths, n in [x for x in dealt if sum(x[0]) <= capacity]:
        own, room = max(lengths), capacity - sum(lengths)
        while n:
            # the longest document left over that fits in place of the pattern's longest
            longer = max(own, (there & ((2 << own + room) - 1)).bit_length() - 1)
            some = min(n, left[longer]) if longer > own else n
            kind = list(lengths)
            if longer > own:
                add(longer, -some)
                add(own, some)
                kind[kind.index(own)] = longer
            put(tuple((x, 1) for x in kind), some, capacity - sum(kind))
            n -= some
    for length in sorted((x for x, n in left.items() if n), reverse=True):
        n = left[length]
        while n:
            fits = rooms >> length
            if fits:
                room = length + (fits & -fits).bit_length() - 1
                kind, many = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    rooms ^= 1 << room
            else:
                room, kind, many = capacity, (), n
            per = min(room // length, n)
            some = min(many, n // per)
            put((*kind, (length, per)), some, room - per * length)
            n -= some * per
            if kind and many > some:
                put(kind, many - some, room)
    return [(kind, n) for room in sorted(open_) for kind, n in open_[room]]


def plan_of(bins: Bins) -> np.ndarray:
    """Rows (length, lo, base, per, at) of the runs, in order of length and lo."""
    met: dict[int, int] = {}
    rows, base = [], 0
    for kind, n in bins:
        at = 0
        for length, per in kind:
            lo = met.get(length, 0)
            rows.append((length, lo, base, per, at))
            met[length] = lo + n * per
            at += length * per
        base += n
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, number long"


def _encode(vocabulary: str, capacity: int, end_id: int, remembered: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encode_all = word_encoder(vocabulary, remembered).encode_all
        met = [0] * (capacity + 1)
        for batch in batches:
            for portion in portions(batch, 1, PORTION):
                ids, sizes = encode_all(portion.column(1), end_id)
                rows, first = [], 0
                for doc, n in zip(portion.column(0).to_pylist(), sizes.tolist(), strict=True):
                    own = ids[first : first + n]
                    first += n
                    for piece, a in enumerate(range(0, n, capacity)):
                        some = own[a : a + capacity]
                        rows.append((doc, piece, a, len(some), zlib.crc32(some), part, met[len(some)]))
                        met[len(some)] += 1
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in _PIECES.split(", ")])

    return run


_PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def _place(plan: np.ndarray):
    keys = (plan[:, 0] << 44) + plan[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = (batch.column(c).to_numpy() for c in ("length", "number"))
            _, lo, base, per, at = plan[np.searchsorted(keys, (length << 44) + number, "right") - 1].T
            sequence, nth = np.divmod(number - lo, per)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(base + sequence), pa.array(at + nth * length)], names=[x.split()[0] for x in _PLACED.split(", ")])

    return run


def pack_by_patterns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, capacity: int = 4096, end_id: int = 1, remembered: int = REMEMBERED) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is the ids of its whole text (null: empty) and the end id. One longer than the
    capacity is cut into pieces of it, the last of which may be shorter; nothing else is cut.
    Repeated rows are repeated documents; a null id stays null; other columns are not read; an
    empty table gives no rows. Equal lengths are dealt in any order. The driver holds the
    histogram and the plan, whose sizes depend on the capacity alone.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = settle(rows.mapInArrow(_encode(vocabulary or vocabulary_path("word_bpe_49k.json"), capacity, end_id, remembered), _PIECES), "pieces")
    counts = settle(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = plan_of(packed_bins(histogram, capacity))
    before = counts.select("part", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    # it has a row for every length of every task, so it is merged, never broadcast
    numbered = pieces.join(before.hint("merge"), ["part", "length"]).withColumn("number", F.col("number") + F.col("before"))
    return numbered.select("doc_id", "piece", "start", "length", "ids_crc32", "number").mapInArrow(_place(plan), _PLACED)
