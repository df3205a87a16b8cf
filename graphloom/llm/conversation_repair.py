"""Conversation structure repair by weighted finite-state composition.

A conversation's rows are an input acceptor, one arc a row. The edit transducer keeps,
re-roles or deletes a row, or inserts one; the role grammar accepts `(s?(ua)+)?` over
initials of roles. Their composition is never built: its states are (row, inserts since
the row before, grammar state), and the shortest path to the end goes through them in
reverse topological order with weights (cost, label string) that are compared
lexicographically. Labels are put in front of a path's string, which keeps the order.

Conversations of up to `long_rows` rows and `long_bytes` bytes are mended whole in one
task. Longer ones are cut into blocks, each block becomes a matrix of weights from grammar
state to grammar state, and only the matrices of a conversation meet.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, groupby
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import lookup, settle, shuffle_width, small_batches

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
#: Fixed costs of the edits, and of a truncated row that stays.
COSTS = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
TRUNCATED = 1
ROLES = {"u": "user", "a": "assistant"}
#: The grammar's states: nothing yet, after a system row, after a user row, after an assistant row; arcs by initial; states in which it may end.
STATES = range(4)
GRAMMAR = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
ACCEPTS = (0, 3)
LEGAL = {"su", "ua", "au"}
#: More inserts in a row than this come back to a grammar state they left.
INSERTS = 2

Weight = tuple[int, str]
_BLANK = " \t\n\v\f\r"
LONG_ROWS, LONG_BYTES, BLOCK_ROWS = 2048, 8 << 20, 512


def edits(mark: str) -> list[tuple[str, int, str]]:
    """Arcs of the edit transducer for a row: label, cost, initial of the role given out ('' for none). A row is its mark, see `mark_of`."""
    if mark == "x":
        return [(DELETE, COSTS[DELETE], "")]
    more = TRUNCATED if mark.isupper() or mark == "!" else 0
    kept = [(KEEP, COSTS[KEEP] + more, mark.lower())] if mark.lower() in "sua" else []
    return [*kept, *((REROLE, COSTS[REROLE] + more, u) for u in ROLES), (DELETE, COSTS[DELETE], "")]


def mark_of(role: str, fault: str) -> str:
    """A row as one sign: its role's initial, upper case if truncated; another initial is `?` or `!`; `x` must go."""
    if fault in ("blank", "duplicate"):
        return "x"
    first = role[:1]
    if first not in ("s", "u", "a"):
        return "!" if fault else "?"
    return first.upper() if fault else first


def _least(a: Weight | None, b: Weight | None) -> Weight | None:
    return b if a is None or (b is not None and b < a) else a


def _inserted(after: list[Weight | None]) -> list[Weight | None]:
    """Least weights with up to INSERTS inserted rows before: `after` are those without."""
    now = after
    for _ in range(INSERTS):
        further: list[Weight | None] = list(after)
        for (g, role), to in GRAMMAR.items():
            if role in ROLES and (w := now[to]) is not None:
                further[g] = _least(further[g], (w[0] + COSTS[INSERT], INSERT + w[1]))
        now = further
    return now


def shortest(marks: str, end: list[Weight | None]) -> list[Weight | None]:
    """Per grammar state before these rows, the least weight to the states of `end` behind them; no insert follows the last row."""
    now = end
    for mark in reversed(marks):
        here: list[Weight | None] = [None] * len(STATES)
        for label, cost, role in edits(mark):
            for g in STATES:
                to = g if not role else GRAMMAR.get((g, role))
                if to is not None and (w := now[to]) is not None:
                    here[g] = _least(here[g], (w[0] + cost, label + w[1]))
        now = _inserted(here)
    return now


#: Least weights from each grammar state to an accepted end, behind the last row.
ENDS = _inserted([(0, "") if g in ACCEPTS else None for g in STATES])


def best_edits(marks: str) -> Weight:
    """Cost and labels of the cheapest edits of a conversation, the ASCII-least of several."""
    return _remembered(marks) if len(marks) <= 64 else shortest(marks, ENDS)[0]


@lru_cache(1 << 15)
def _remembered(marks: str) -> Weight:
    return shortest(marks, ENDS)[0]


def matrix(marks: str) -> list[list[Weight | None]]:
    """Least weights of a block from each grammar state before it to each behind it.

    A block's path ends with a row's label, never with an insert, so of two paths through
    it neither is the start of the other, and their order stays whatever follows.
    """
    columns = [shortest(marks, [(0, "") if g == e else None for g in STATES]) for e in STATES]
    return [[columns[e][g] for e in STATES] for g in STATES]


def chained(blocks: list[list[list[Weight | None]]]) -> tuple[int, list[tuple[str, int]], str]:
    """Cost of the cheapest edits through blocks in order, per block (labels, grammar state before it), and the labels behind the last."""
    costs: list[int | None] = [w and w[0] for w in ENDS]
    ranks = [sorted({w[1] for w in ENDS if w}).index(w[1]) if w else 0 for w in ENDS]
    steps: list[list[int | None]] = []
    for block in reversed(blocks):
        found: list[tuple | None] = []
        for g in STATES:
            ways = [(w[0] + costs[e], w[1], ranks[e], e) for e in STATES if (w := block[g][e]) is not None and costs[e] is not None]
            found.append(min(ways, default=None))
        order = sorted({w[1:3] for w in found if w})
        costs, ranks = [w and w[0] for w in found], [order.index(w[1:3]) if w else 0 for w in found]
        steps.append([w and w[3] for w in found])
    g, pieces = 0, []
    for block, step in zip(blocks, reversed(steps), strict=True):
        pieces.append((block[g][step[g]][1], g))
        g = step[g]
    return costs[0], pieces, ENDS[g][1]


def edited(labels: str, rows: Iterable[tuple[str, str]], state: int = 0) -> Iterator[tuple[str, str]]:
    """Rows (role, text) after these edits, from a grammar state on."""
    rows = iter(rows)
    for label in labels:
        if label == INSERT:
            row = ("", "")
        else:
            row = next(rows)
            if label == DELETE:
                continue
        if label != KEEP:
            row = (ROLES["a" if state == 2 else "u"], row[1])
        state = GRAMMAR[state, row[0][:1]]
        yield row


def end_of(text: str) -> str:
    """'blank', 'truncated' or '': what a row's text alone tells."""
    last = text.rstrip(_BLANK)[-1:]
    return "blank" if not last else "" if last in ".!?" else "truncated"


def _digest(role: str, text: str) -> bytes:
    return hashlib.blake2b(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass"), digest_size=16).digest()


def faults(rows: list[tuple[str, str]]) -> list[str]:
    """Each row's first fault: blank, duplicate, truncated or ''."""
    seen: set[tuple[str, str]] = set()
    out = []
    for row in rows:
        fault = end_of(row[1])
        if fault != "blank":
            if row in seen:
                fault = "duplicate"
            seen.add(row)
        out.append(fault)
    return out


def _bad(initials: list[str]) -> int:
    return sum(a + b not in LEGAL for a, b in zip(initials[:-1], initials[1:], strict=True))


def _gaps(first: int | None, last: int | None, distinct: int) -> int:
    return 0 if first is None else last - first + 1 - distinct


_REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_NAMES = [x.split()[0] for x in _REPORT.split(", ")]
_TURNS = "place long, role string, text string"


def mended(rows: list[tuple[int | None, str, str]]) -> tuple[dict[str, Any], list[tuple[str, str]]]:
    """Report and repaired rows of a whole conversation (turn, role, text) in order."""
    plain = [r[1:] for r in rows]
    found = faults(plain)
    cost, audit = best_edits("".join(mark_of(r[0], f) for r, f in zip(plain, found, strict=True)))
    turns = {t for t, _, _ in rows if t is not None}
    out = list(edited(audit, plain))
    told = {"gaps": _gaps(min(turns, default=None), max(turns, default=None), len(turns)), "blank": found.count("blank"), "duplicate": found.count("duplicate"), "truncated": found.count("truncated")}
    return told | {"illegal": _bad([r[0][:1] for r in plain]), "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode("utf-8", "surrogatepass")).hexdigest()}, out


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str], columns: list[str]) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """(keys, the other columns' rows) of a partition sorted by its keys; the rows are an iterator over the batches."""
    n = len(keys)

    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in [*keys, *columns]), strict=True)

    for key, run in groupby(rows(), key=lambda r: r[:n]):
        yield key, (r[n:] for r in run)


class _Out:
    """Result rows, handed out as batches of a bounded number of rows and bytes."""

    def __init__(self, schema: pa.Schema) -> None:
        self.schema, self.rows, self.size = schema, [], 0

    def put(self, row: tuple, size: int = 0) -> None:
        self.rows.append(row)
        self.size += size

    def full(self) -> bool:
        return len(self.rows) >= 2000 or self.size >= 4 << 20

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) if self.rows else [()] * len(self.schema)
        self.rows, self.size = [], 0
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, self.schema, strict=True)], schema=self.schema)


_ARROW = {"long": pa.int64(), "string": pa.string(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(x.split()[0], _ARROW[x.split()[1]]) for x in ddl.split(", ")])


def _mend(turns: bool):
    """Whole conversations: their reports, or their repaired rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Out(_schema("key string, " + (_TURNS if turns else _REPORT)))
        for (key,), rows in _runs(batches, ["key"], ["gone", "turn", "role", "text"]):
            told, fixed = mended([r[1:] for r in rows if not r[0]])
            if turns:
                for k, (role, text) in enumerate(fixed):
                    out.put((key, k, role, text), len(text))
            else:
                out.put((key, *(told[c] for c in _NAMES)), len(told["audit"]))
            if out.full():
                yield out.batch()
        yield out.batch()

    return run


# Long conversations, block by block.

_LIGHT = "key string, block long, place long, turn long, role string, text string, digest binary, fault string"


def _blocks(block_rows: int):
    """Rows of a sorted partition with a place that rises along the conversation, the block they lie in, and what the text alone tells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 40
        out = _Out(_schema(_LIGHT))
        for (key,), rows in _runs(batches, ["key"], ["turn", "role", "text"]):
            for k, (turn, role, text) in enumerate(rows):
                out.put((key, base + k - k % block_rows, base + k, turn, role, text, _digest(role, text), end_of(text)), len(text))
                if out.full():
                    yield out.batch()
        yield out.batch()

    return run


_BLOCK = "key string, block long, n_blank long, n_duplicate long, n_truncated long, n_illegal long, head string, tail string, last long, lowest long, n_turns long, weights string"


def _summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a block: counts, what stands at its borders, and its matrix."""
    out = _Out(_schema(_BLOCK))
    for key, run in _runs(batches, ["key", "block"], ["turn", "role", "fault"]):
        rows = list(run)
        found = [f for *_, f in rows]
        heads = [r[:1] for _, r, _ in rows]
        turns = [t for t, _, _ in rows if t is not None]
        marks = "".join(mark_of(r, f) for _, r, f in rows)
        out.put((*key, found.count("blank"), found.count("duplicate"), found.count("truncated"), _bad(heads), heads[0], heads[-1], rows[-1][0], min(turns, default=None), len(set(turns)), json.dumps(matrix(marks))), 16 * len(marks))
        if out.full():
            yield out.batch()
    yield out.batch()


_CHAINED = "key string, block long, state long, labels string, behind string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks of a conversation in order: each block's labels; its first one carries the conversation's counts, its last one the labels behind it."""
    out = _Out(_schema(_CHAINED))
    names = [x.split()[0] for x in _BLOCK.split(", ")][1:]
    for (key,), rows in _runs(batches, ["key"], names):
        blocks = [dict(zip(names, r, strict=True)) for r in rows]
        cost, pieces, behind = chained([[[w and tuple(w) for w in row] for row in json.loads(b.pop("weights"))] for b in blocks])
        total = lambda c: sum(b[c] for b in blocks)
        between = [(a, b) for a, b in zip(blocks[:-1], blocks[1:], strict=True)]
        lows, ends = [b["lowest"] for b in blocks if b["lowest"] is not None], [b["last"] for b in blocks if b["last"] is not None]
        distinct = total("n_turns") - sum(a["last"] is not None and a["last"] == b["lowest"] for a, b in between)
        gaps = _gaps(min(lows, default=None), max(ends, default=None), distinct)
        illegal = total("n_illegal") + sum(a["tail"] + b["head"] not in LEGAL for a, b in between)
        counts = (gaps, total("n_blank"), total("n_duplicate"), total("n_truncated"), illegal, cost)
        for k, (b, (labels, state)) in enumerate(zip(blocks, pieces, strict=True)):
            out.put((key, b["block"], state, labels, behind if k == len(blocks) - 1 else "", *(counts if k == 0 else [None] * 6)), len(labels))
            if out.full():
                yield out.batch()
    yield out.batch()


def _join_up(turns: bool):
    """Rows of long conversations in order with their blocks' labels: repaired rows, or reports. The text of a conversation is never held; a hash runs along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Out(_schema("key string, " + (_TURNS if turns else _REPORT)))
        columns = ["block", "role", "text", "state", "labels", "behind", *_NAMES[:6]]
        for (key,), rows in _runs(batches, ["key"], columns):
            told, audit, place, sha = None, [], 0, hashlib.sha256()
            for _, inner in groupby(rows, key=lambda r: r[0]):
                first = next(inner)
                state, labels, behind = first[3:6]
                told = told or first[6:]
                audit += [labels, behind]
                for role, text in edited(labels + behind, (r[1:3] for r in chain([first], inner)), state):
                    if turns:
                        out.put((key, place, role, text), len(text))
                        if out.full():
                            yield out.batch()
                    else:
                        sha.update(f"{chr(10) if place else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
                    place += 1
                for _ in inner:  # rows deleted at the end are read to the last
                    pass
            if not turns:
                out.put((key, *told, "".join(audit), sha.hexdigest()))
            if out.full():
                yield out.batch()
        yield out.batch()

    return run


def _long(rows: DataFrame, turns: bool, block_rows: int) -> DataFrame:
    """As `_mend`, for conversations of any length: ordered by ranges, marked and summed up block by block."""
    width = shuffle_width(rows.sparkSession)
    # a number of their own deals equal rows over ranges; among them, any order is the same
    ranged = rows.withColumn("deal", F.monotonically_increasing_id())
    order = [F.col("key"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    ranged = ranged.repartitionByRange(width, "key", F.col("turn").asc_nulls_first(), "role", "text", "deal").sortWithinPartitions(*order)
    placed = settle(ranged.mapInArrow(_blocks(block_rows), _LIGHT), "placed")
    spoken = placed.where("fault <> 'blank'")
    # the least place of each text is a sum, so a text said very often is never gathered
    first = spoken.groupBy("key", "digest").agg(F.min("place").alias("least"), F.max("place").alias("most")).where("least < most").select("key", "digest", "least")
    light = placed.select("key", "block", "place", "turn", "role", "digest", "fault").join(first, ["key", "digest"], "left")
    light = light.withColumn("fault", F.when((F.col("fault") != "blank") & (F.col("place") > F.col("least")), "duplicate").otherwise(F.col("fault")))
    summed = light.repartition(width, "key", "block").sortWithinPartitions("key", "block", "place").mapInArrow(_summarise, _BLOCK)
    # a conversation's blocks meet: one row for every `block_rows` rows
    labels = settle(summed.repartition(width, "key").sortWithinPartitions("key", "block").mapInArrow(_chain, _CHAINED), "labels")
    whole = placed.select("key", "block", "place", "role", "text").join(labels, ["key", "block"])
    schema = "key string, " + (_TURNS if turns else _REPORT)
    return whole.repartition(width, "key").sortWithinPartitions("key", "place").mapInArrow(_join_up(turns), schema)


def _repair(rows: DataFrame, turns: bool, gone: Column | None, long_rows: int, long_bytes: int, block_rows: int) -> DataFrame:
    spark = rows.sparkSession
    small_batches(spark)
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    copy = F.col("copy") if "copy" in rows.columns else F.lit(0)
    key = F.when(F.col("conv_id").isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), F.col("conv_id").cast("string")))
    rows = rows.select(key.alias("key"), (F.lit(False) if gone is None else gone).alias("gone"), F.col("turn").cast("long").alias("turn"), blank("role").alias("role"), blank("text").alias("text"), copy.alias("copy"))
    there = F.when(~F.col("gone"), 1).otherwise(0)
    sizes = rows.groupBy("key").agg(F.sum(there).alias("n"), F.sum(there * F.octet_length("text")).alias("bytes"))
    long = settle(sizes.where((F.col("n") > long_rows) | (F.col("bytes") > long_bytes)).select("key"), "long")
    n = long.count()
    few = rows
    if n:
        marked = lookup(rows, long.withColumn("long", F.lit(True)), "key", n)
        few = marked.where("long is null").drop("long")
    order = [F.col("key"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("copy")]
    schema = "key string, " + (_TURNS if turns else _REPORT)
    out = few.repartition("key").sortWithinPartitions(*order).mapInArrow(_mend(turns), schema)
    if n:
        out = out.union(_long(marked.where("long and not gone").drop("long", "gone"), turns, block_rows))
    return out


def structure_report(rows: DataFrame, gone: Column | None = None, long_rows: int = LONG_ROWS, long_bytes: int = LONG_BYTES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    rows: conv_id, turn, role, text; `gone` marks rows that only tell that their conversation
    exists. Rows stand in order of turn (nulls first), role, text and, if there is such a column,
    `copy`. Null roles and texts are one space; rows with a null conv_id are one conversation.
    Other columns are not read. A conversation without rows has zeros, an empty audit and the
    hash of the empty string. An empty table gives no rows.

    The hash of a long conversation runs through its rows in one task, one row at a time:
    one SHA-256 can't be computed in parts. All else about it is computed block by block.
    """
    kind = rows.schema["conv_id"].dataType
    id_of = F.when(F.col("key") != "n", F.substring("key", 2, 1 << 30)).cast(kind)
    return _repair(rows, False, gone, long_rows, long_bytes, block_rows).select(id_of.alias("conv_id"), *_NAMES)


def repaired_turns(rows: DataFrame, gone: Column | None = None, long_rows: int = LONG_ROWS, long_bytes: int = LONG_BYTES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The repaired conversations: conv_id, place (from 0), role, text. As `structure_report` reads them; one without rows gives none."""
    kind = rows.schema["conv_id"].dataType
    id_of = F.when(F.col("key") != "n", F.substring("key", 2, 1 << 30)).cast(kind)
    return _repair(rows, True, gone, long_rows, long_bytes, block_rows).select(id_of.alias("conv_id"), "place", "role", "text")


def damaged(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, copy, gone) after damage that a hash of id and turn decides; nulls of them are one space there."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    text = F.when(fate == 1, "").when(fate == 2, F.translate(blank("text"), ".!?", "")).when(fate == 0, "").otherwise(blank("text"))
    role = F.when(fate == 4, "user").otherwise(blank("role"))
    out = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (fate == 0).alias("gone"), F.when(fate == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))).alias("copies"))
    return out.withColumn("copy", F.explode("copies")).drop("copies")


def repair_digest(rows: DataFrame) -> DataFrame:
    """`structure_report` of the damaged conversations, one row per original conv_id."""
    return structure_report(damaged(rows), F.col("gone"))
