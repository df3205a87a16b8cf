"""Filter interaction audit over a packed bitmap index.

Each task packs its rows' outcomes into NumPy bitsets, one a filter and one a label, with
the rows in order of their part, so that a part's bitset is a run of set bits. For every
set of filters that may come first, the rows that are left are the part's bits AND-NOT
those filters' bits; a popcount with the next filter's bits, and with a label's, gives what
that filter takes away there. The counts of 80 (set, next filter) pairs a part are summed
over tasks, and any order of the filters is read off them.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import combinations, permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import settle, small_batches

FILTERS = "ABCDE"
_UPPER, _SIGNS = bytes(range(65, 91)), b"#$%&*|"
#: Rows whose bits a task holds at a time.
CHUNK = 1 << 20
#: A text that more than one in COMMON rows has is looked up in a broadcast table, of COMMON rows at most.
COMMON = 4096
#: Bits of a row above those of its filters.
_GOOD, _TOXIC = 1 << len(FILTERS), 2 << len(FILTERS)
_COUNTS = "part string, before int, filter string, alive long, removed long, good_lost long, toxic_lost long"


def outcome(text: str) -> int:
    """Bits of the filters A to D that a whole text fails."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # at the bytes 0x20 and 0x09 to 0x0D
    short = len(words) < 200
    repeated = 100 * len(set(words)) < 50 * len(words)
    capitals = 100 * (len(data) - len(data.translate(None, _UPPER))) > 3 * len(text)
    signs = len(data.translate(None, _SIGNS)) < len(data)
    return short | repeated << 1 | capitals << 2 | signs << 3


def _outcomes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bits, digests = [], []
        for text in batch.column("text"):
            text = text.as_py() or ""
            bits.append(outcome(text))
            digests.append(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), pa.array(bits, pa.int32()), pa.array(digests, pa.binary())], names=["doc_id", "part", "bits", "digest"])


def first_sets() -> list[tuple[int, int]]:
    """(set of filters that came before as bits, the next filter), each set after those that it grows from."""
    n = len(FILTERS)
    sets = [sum(1 << f for f in some) for k in range(n) for some in combinations(range(n), k)]
    return [(s, f) for s in sets for f in range(n) if not s >> f & 1]


def _ones(bits: np.ndarray) -> int:
    return int(np.bitwise_count(bits).sum())


def counted(parts: np.ndarray, bits: np.ndarray) -> list[tuple]:
    """(part, set before, filter, alive, removed, good lost, toxic lost) of some rows; `parts` are small integers, rising."""
    index = [np.packbits(bits >> k & 1 != 0) for k in range(len(FILTERS) + 2)]
    good, toxic = index[-2:]
    out = []
    cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(parts)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        lo, hi = a >> 3, (b + 7) >> 3
        own = np.full(hi - lo, 255, np.uint8)  # the part's bits: a run
        own[0] &= 255 >> (a & 7)
        own[-1] &= 255 << (-b & 7) & 255
        left = {0: own}
        for before, f in first_sets():
            here = left[before]
            gone = here & index[f][lo:hi]
            out.append((int(parts[a]), before, f, _ones(here), _ones(gone), _ones(gone & good[lo:hi]), _ones(gone & toxic[lo:hi])))
            left.setdefault(before | 1 << f, here & ~index[f][lo:hi])
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []

    def drain() -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        held.clear()
        coded = table["part"].combine_chunks().dictionary_encode()
        codes = coded.indices.to_numpy()
        order = np.argsort(codes, kind="stable")
        rows = counted(codes[order], table["bits"].to_numpy()[order])
        columns = list(zip(*rows, strict=True))
        names = coded.dictionary.to_pylist()
        return pa.RecordBatch.from_arrays(
            [pa.array([names[p] for p in columns[0]], pa.string()), pa.array(columns[1], pa.int32()), pa.array([FILTERS[f] for f in columns[2]], pa.string()), *(pa.array(c, pa.int64()) for c in columns[3:])],
            names=["part", "before", "filter", "alive", "removed", "good_lost", "toxic_lost"],
        )

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(x.num_rows for x in held) >= CHUNK:
            yield drain()
    if held:
        yield drain()


def outcomes(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row per document: doc_id, part, bits (filters A to E, good, toxic).

    A null text is empty, a null language the empty string. A text is a copy if a smaller id
    has the same one; a null id is neither smaller nor larger, and has no label. Repeated rows
    of an id are copies of none among themselves. Of several labels of an id, one that says so
    makes it good or toxic. Texts meet as digests of 128 bits: a copied text's least id comes
    from a sum by digest, and copies of very common texts find it without being moved, so
    they are never gathered.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.col("text").alias("text"))
    light = settle(rows.mapInArrow(_outcomes, "doc_id long, part string, bits int, digest binary"), "outcomes")
    named = light.where("doc_id is not null")
    copied = named.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count("*").alias("n"))
    copied = settle(copied.where("least < most").select("digest", "least", "n"), "copied")
    common = F.col("n") * COMMON > light.count()
    often, seldom = F.broadcast(copied.where(common).drop("n")), copied.where(~common).drop("n")
    marked = named.join(often, "digest").union(named.join(often, "digest", "left_anti").join(seldom, "digest", "left"))
    noted = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    noted = noted.groupBy("doc_id").agg(F.max(F.when(F.col("good"), _GOOD).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic"), _TOXIC).otherwise(0)).alias("toxic"))
    copy = F.when(F.col("doc_id") > F.col("least"), 1 << FILTERS.index("E")).otherwise(0)
    bits = F.col("bits") + copy + F.coalesce("good", F.lit(0)) + F.coalesce("toxic", F.lit(0))
    out = marked.join(noted, "doc_id", "left").select("doc_id", "part", bits.alias("bits"))
    return out.union(light.where("doc_id is null").select("doc_id", "part", "bits"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the five filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Parts are the values of `lang` (null: empty string); a part has all 600 rows, zeros
    included. Nulls, copies and labels are read as `outcomes` says; other columns are not read;
    an empty table has no parts and gives no rows. `shapley` is the filter's `removed` summed
    over all orders. Only sums of a part go through a shuffle after the bitsets.
    """
    sums = outcomes(docs, labels).select("part", "bits").mapInArrow(_count, _COUNTS)
    sums = settle(sums.groupBy("part", "before", "filter").agg(*[F.sum(c).alias(c) for c in ("alive", "removed", "good_lost", "toxic_lost")]), "audit")
    n = len(FILTERS)
    size = F.bit_count("before")
    orders = F.element_at(F.array(*[F.lit(math.factorial(k) * math.factorial(n - 1 - k)) for k in range(n)]), (size + 1).cast("int"))
    totals = sums.groupBy("part", "filter").agg(
        F.sum(F.when(size == 0, F.col("removed"))).alias("fails"), F.sum(F.when(size == n - 1, F.col("removed"))).alias("unique_fails"), F.sum(F.col("removed") * orders).alias("shapley")
    )
    # 600 rows, whatever the tables hold
    steps = [("".join(p), i + 1, p[i], sum(1 << FILTERS.index(f) for f in p[:i])) for p in permutations(FILTERS) for i in range(n)]
    plan = F.broadcast(docs.sparkSession.createDataFrame(steps, "filter_order string, step int, filter string, before int"))
    out = sums.join(totals, ["part", "filter"]).join(plan, ["before", "filter"])
    return out.select("part", "filter_order", "step", (F.col("alive") - F.col("removed")).alias("kept"), "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley")


#: The same rows in DuckDB: every document's outcomes, then every order's counts from them.
AUDIT_SQL = r"""
with d as (
  select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text from documents),
w as (
  select *, [x for x in string_split_regex(text, '[\x20\x09-\x0D]+') if x <> ''] as words,
    coalesce(doc_id > min(doc_id) over (partition by text), false) as e from d),
l as (
  select doc_id, max(case when quality = 1 then 1 else 0 end) = 1 as good, max(case when toxic = 1 then 1 else 0 end) = 1 as toxic from labels group by doc_id),
f as (
  select part, {'A': len(words) < 200, 'B': 100 * len(list_distinct(words)) < 50 * len(words),
      'C': 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 3 * length(text),
      'D': regexp_matches(text, '[#$%&*|]'), 'E': e} as fails, coalesce(good, false) as good, coalesce(toxic, false) as toxic
  from w left join l using (doc_id)),
m as (
  select part, [x for x in ['A', 'B', 'C', 'D', 'E'] if case x when 'A' then fails.A when 'B' then fails.B when 'C' then fails.C when 'D' then fails.D else fails.E end] as failed, good, toxic, count(*) as n
  from f group by all),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as c),
orders as (
  select a.c || b.c || c.c || d.c || e.c as filter_order from letters a, letters b, letters c, letters d, letters e
  where len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
steps as (select filter_order, cast(step as int) as step, substr(filter_order, step, 1) as f, string_split(substr(filter_order, 1, step - 1), '') as before from orders, range(1, 6) r(step)),
c as (
  select part, filter_order, step, f,
    sum(case when not list_has_any(failed, before) and not list_contains(failed, f) then n else 0 end) as kept,
    sum(case when not list_has_any(failed, before) and list_contains(failed, f) then n else 0 end) as removed,
    sum(case when list_has_any(failed, before) and list_contains(failed, f) then n else 0 end) as redundant,
    sum(case when failed = [f] then n else 0 end) as unique_fails,
    sum(case when not list_has_any(failed, before) and list_contains(failed, f) and good then n else 0 end) as good_lost,
    sum(case when not list_has_any(failed, before) and list_contains(failed, f) and toxic then n else 0 end) as toxic_lost
  from m, steps group by all)
select part, filter_order, step, cast(kept as bigint) as kept, cast(removed as bigint) as removed, cast(redundant as bigint) as redundant,
  cast(unique_fails as bigint) as unique_fails, cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost,
  cast(sum(removed) over (partition by part, f) as bigint) as shapley
from c
"""
