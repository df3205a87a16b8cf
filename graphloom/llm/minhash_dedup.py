"""MinHash near-dedup with an LSH forest.

A document's set holds its distinct 5-word shingles. TREES sorted orders of signatures of
DEPTH min-hash values each are scanned; neighbours whose signatures share a prefix of at
least LEAST values are candidates. The depth adapts to the region: while more than REGION
documents share a prefix it grows by one value, and at the depth where at most REGION do, all
of them are compared; documents that even DEPTH values don't part are compared with the next
NEAR in order. Candidates are confirmed on full sets. So far nothing but the order decides, and a
crowded region may hide pairs that part early. They come in two steps: a document refused by a
member of a group is confirmed against the hubs of that group, which joins most of a crowd
cheaply; then whatever a region of more than REGION documents still holds in different groups
is compared pair by pair, with no bound on partners: whole signatures in blocks, and in a
block full sets where those agree as alike documents do. A block gives the groups that it
joins, so a crowd of n documents that stay apart makes no rows of n^2 pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import FEW, Forest, components, discard, lookup, release, settle, small_batches, shuffle_width, sorted_groups, star_batch
from .textbytes import SHINGLE_WORDS, shingles, slices, text_buffers

TREES, DEPTH, LEAST = 20, 8, 3
#: Regions of up to this many documents are compared wholly; larger ones deeper in the order, and at its end the next NEAR.
REGION, NEAR = 10, 2
#: Documents of a group that the refused are confirmed against before the pairs that are left, and parts of a group they come from.
HUBS, PARTS = 12, 64
#: Pairs of one document that meet in a task; the pairs of a hub are dealt over more.
HOT = 512
#: Documents of a region are compared in blocks of BLOCK, fewer where these hold more than BLOCK_SHINGLES. Of TREES * DEPTH values, a pair at 75 percent agrees in fewer than ALIKE once in millions.
BLOCK, BLOCK_SHINGLES, ALIKE = 512, 1 << 20, 92
#: Shingles of two blocks that are counted at once.
AT_ONCE = 2048


def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20)
    return (r.integers(1, 1 << 32, n, dtype=np.uint64) | np.uint64(1)).astype(np.uint32), r.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)


def signature(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least values of len(a) hash functions over a set, as 16-bit codes."""
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), 512):
        x = low[i : i + 512, None] * a + b
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        np.minimum(least, x.min(0), out=least)
    # the least value of a large set is small, so a code takes from all of its bits
    least ^= least >> np.uint32(16)
    least *= np.uint32(0x7FEB352D)
    least ^= least >> np.uint32(15)
    return (least * np.uint32(0x846CA68B) >> np.uint32(16)).astype(np.uint16)


def mark_of(shingle_hashes: np.ndarray) -> bytes:
    """17 bytes that tell sets apart."""
    s = shingle_hashes
    return (int(s.sum(dtype=np.uint64)) ^ (len(s) << 1)).to_bytes(9, "big") + int(np.bitwise_xor.reduce(s * np.uint64(0x9E3779B97F4A7C15) ^ (s >> np.uint64(29)))).to_bytes(8, "big")


def _signatures(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        a, b = _coefficients(TREES * DEPTH)
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            sizes, marks, keys = [], [], []
            for lo, hi in slices(offsets):
                for s in shingles(data, offsets[lo : hi + 1], k):
                    sizes.append(len(s))
                    if len(s):
                        marks.append(mark_of(s))
                        keys.append(signature(s, a, b).astype(">u2").tobytes())
                    else:
                        marks.append(None)
                        keys.append(None)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes, pa.int64()), pa.array(marks, pa.binary()), pa.array(keys, pa.binary())], names=["id", "n_shingles", "mark", "keys"])

    return run


_PAIRS = "a long, b long, border int, place long, id long, tree int, key binary"


def region_pairs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidate pairs of the rows of one sorted region (n x DEPTH codes), and its rows if it is crowded.

    A region of up to REGION rows gives all its pairs; a larger one is cut where the next value
    changes. What is left at the end of the order gives each row's next NEAR.
    """
    n = len(key)
    left, right = [], []
    open_ = [(0, n, LEAST)]
    while open_:
        a, b, depth = open_.pop()
        size = b - a
        if size < 2:
            continue
        if size <= REGION or depth == DEPTH:
            steps = size if size <= REGION else NEAR + 1
            for step in range(1, steps):
                i = np.arange(a, b - step)
                left.append(i)
                right.append(i + step)
            continue
        cuts = [a, *(np.flatnonzero(key[a + 1 : b, depth] != key[a : b - 1, depth]) + a + 1).tolist(), b]
        open_ += [(x, y, depth + 1) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
    none = np.zeros(0, np.int64)
    return np.concatenate(left) if left else none, np.concatenate(right) if right else none, np.arange(n) if n > REGION else none


def _neighbours(borders: bool):
    """Candidate pairs of a partition sorted by (tree, key); a document of a crowded region is also paired with itself.

    With `borders`, the first and the last REGION rows are given too, for regions that reach
    into the next partition. Regions of any size are cut at CHUNK rows; a cut is one more border of a crowd.
    """
    chunk = 1 << 16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        here = TaskContext.get().partitionId()
        names = [f.split()[0] for f in _PAIRS.split(", ")]

        def pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            n = len(a)
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), *(pa.nulls(n, t) for t in (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()))], names=names)

        def edge(rows: list[tuple], border: int, after: int) -> pa.RecordBatch:
            n = len(rows)
            return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array([border] * n, pa.int32()), pa.array([p + after for p, *_ in rows], pa.int64()), pa.array([i for _, i, _, _ in rows], pa.int64()), pa.array([t for *_, t, _ in rows], pa.int32()), pa.array([k for *_, k in rows], pa.binary())], names=names)

        held_key, held_id = np.zeros((0, DEPTH + 1), np.uint16), np.zeros(0, np.int64)
        place, first, last = 0, [], []

        def regions(key: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
            cuts = [0, *(np.flatnonzero((key[1:, : LEAST + 1] != key[:-1, : LEAST + 1]).any(1)) + 1).tolist(), len(ids)]
            left, right = [], []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b - a == 2:
                    left.append(ids[a : a + 1])
                    right.append(ids[a + 1 : b])
                elif b - a > 2:
                    i, j, crowd = region_pairs(key[a:b, 1:])
                    left += [ids[a + i], ids[a + crowd]]
                    right += [ids[a + j], ids[a + crowd]]
            if left:
                x, y = np.concatenate(left), np.concatenate(right)
                yield pairs(x, y)

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            trees, blobs, ids = batch.column("tree").to_pylist(), batch.column("key").to_pylist(), batch.column("id").to_numpy()
            key = np.empty((n, DEPTH + 1), np.uint16)
            key[:, 0] = trees
            key[:, 1:] = np.frombuffer(b"".join(blobs), ">u2").reshape(n, DEPTH)
            if borders:
                rows = lambda a, b, at=place, i=ids, t=trees, k=blobs: [(at + x, int(i[x]), t[x], k[x]) for x in range(a, b)]
                first += rows(0, min(n, REGION - len(first)))
                last = [*last, *rows(max(0, n - REGION), n)][-REGION:]
                place += n
            if len(held_id):
                key, ids = np.concatenate([held_key, key]), np.concatenate([held_id, ids])
            # the last region may go on in the next batch
            change = np.flatnonzero((key[1:, : LEAST + 1] != key[:-1, : LEAST + 1]).any(1))
            cut = int(change[-1]) + 1 if len(change) else 0
            if len(ids) - cut > chunk:
                yield from regions(key, ids)
                cut = len(ids) - REGION - 1  # known to be crowded: enough rows go on to show it
                held_key, held_id = key[cut:], ids[cut:]
                continue
            if cut:
                yield from regions(key[:cut], ids[:cut])
            held_key, held_id = key[cut:], ids[cut:]
        if len(held_id):
            yield from regions(held_key, held_id)
        if borders:
            yield edge(last, here, 0)
            if here:
                yield edge(first, here - 1, 1 << 40)

    return run


#: Bits of the filter that spares most texts without candidates a second look: 2 MB, whatever the input.
FILTER_BITS = 1 << 24


def _filter(ids: DataFrame) -> bytes:
    """A bitmap of hashed ids. Its size is fixed; with many ids it only lets more texts through."""
    word = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS))
    rows = ids.select(F.floor(word / 64).cast("int").alias("w"), F.expr("shiftleft(1L, cast(pmod(xxhash64(id), 64) as int))").alias("bit")).groupBy("w").agg(F.expr("bit_or(bit)").alias("bits"))
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    for w, b in rows.toLocalIterator():
        bits[w] = b
    return bits.tobytes()


def _sets(k: int, bits):
    """The sets and their marks of rows whose id the filter may hold. The hash is Spark's own, so it comes as a column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        table = np.frombuffer(bits.value, np.int64)
        for batch in batches:
            h = batch.column("h").to_numpy()
            hit = (table[(h % FILTER_BITS) // 64] >> (h % 64)) & 1
            likely = batch.filter(pa.array(hit.astype(bool)))
            data, offsets = text_buffers(likely.column("text"))
            out, marks = [], []
            for lo, hi in slices(offsets):
                for s in shingles(data, offsets[lo : hi + 1], k):
                    out.append(s.tobytes())
                    marks.append(mark_of(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([likely.column("id"), pa.array(marks, pa.binary()), pa.array(out, pa.binary())], names=["id", "mark", "set"])

    return run


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    for batch in batches:
        shared, total = [], []
        for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            shared.append(both)
            total.append(len(x) + len(y) - both)
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(shared, pa.int64()), pa.array(total, pa.int64())], names=["a", "b", "shared", "total"])


def _with_set(pairs: DataFrame, sets: DataFrame, end: str, made: list[DataFrame]) -> DataFrame:
    """The pairs with the set of one end. Pairs of an end that stands in more than HOT of them are dealt over several tasks, each with a copy of its set. Tables that this takes go to `made`."""
    named = sets.select(F.col("id").alias(end), F.col("set").alias(f"set_{end}"))
    hot = settle(pairs.groupBy(end).count().where(F.col("count") > HOT).select(end, F.ceil(F.col("count") / HOT).cast("int").alias("tasks")), "hot")
    made.append(hot)
    n = hot.count()
    if not n:
        return pairs.join(named, end)
    other = next(c for c in ("a", "b") if c != end)
    dealt = lookup(pairs, hot, end, n).na.fill({"tasks": 1}).withColumn("task", F.pmod(F.xxhash64(other), F.col("tasks")).cast("int")).drop("tasks")
    copies = lookup(named, hot, end, n).na.fill({"tasks": 1}).withColumn("task", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1))).drop("tasks")
    return dealt.join(copies, [end, "task"]).drop("task")


def _confirmed(pairs: DataFrame, sets: DataFrame, made: list[DataFrame]) -> DataFrame:
    both = _with_set(_with_set(pairs, sets, "a", made), sets, "b", made)
    return both.select("a", "b", "set_a", "set_b").mapInArrow(_confirm, "a long, b long, shared long, total long")


_AT = ["tree", "prefix", "lo", "hi"]
_OPEN = "tree int, prefix long, lo int, hi int, block int, id long, component long"


def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of two blocks whose signature agrees with one of another group, each pair in the first tree where both share a region."""
    release()
    for table in sorted_groups(batches, _AT):
        tree, lo, hi = (table[k][0].as_py() for k in ("tree", "lo", "hi"))
        block, ids, group = (table[k].to_numpy() for k in ("block", "id", "component"))
        key = np.frombuffer(b"".join(table["keys"].to_pylist()), ">u2").astype(np.uint16).reshape(len(ids), TREES * DEPTH)
        a, b = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
        apart = group[a][:, None] != group[b][None, :]
        for t in range(tree):
            x = key[:, t * DEPTH : t * DEPTH + LEAST]
            apart &= (x[a][:, None, :] != x[b][None, :, :]).any(2)
        if not apart.any():
            continue
        agree = np.zeros(apart.shape, np.int16)
        for i in range(TREES * DEPTH):
            agree += key[a, i][:, None] == key[b, i][None, :]
        apart &= agree >= ALIKE
        asked = np.zeros(len(ids), bool)
        asked[a] |= apart.any(1)
        asked[b] |= apart.any(0)
        if asked.any():
            yield from table.drop_columns(["keys"]).filter(pa.array(asked)).combine_chunks().to_batches()


def shared_sizes(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Intersection sizes of the sets `a` with the sets `b`, which name places in `sets`."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # what stands in one set alone is in no intersection
    common = times > 1
    number = np.cumsum(common) - 1
    held = common[place]
    owner, number = owner[held], number[place[held]]
    order = np.argsort(number, kind="stable")
    owner, number = owner[order], number[order]
    out = np.zeros((len(a), len(b)), np.int64)
    for first in range(0, int(common.sum()), AT_ONCE):
        some = slice(*np.searchsorted(number, [first, first + AT_ONCE]).tolist())
        there = np.zeros((len(sets), AT_ONCE), np.float32)
        there[owner[some], number[some] - first] = 1
        out += (there[a] @ there[b].T).astype(np.int64)
    return out


def _joined(percent: int):
    """The groups that links between two blocks join, as (group, least of the groups it is joined with)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for table in sorted_groups(batches, _AT):
            block, group = (table[k].to_numpy() for k in ("block", "component"))
            a, b = (np.flatnonzero(block == table[k][0].as_py()) for k in ("lo", "hi"))
            sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in table["set"]]
            sizes = np.array([len(s) for s in sets], np.int64)
            shared = shared_sizes(sets, a, b)
            linked = 100 * shared >= percent * (sizes[a][:, None] + sizes[b][None, :] - shared)
            r, c = np.nonzero(linked & (group[a][:, None] != group[b][None, :]))
            forest = Forest()
            for x, y in np.unique(np.column_stack([group[a[r]], group[b[c]]]), axis=0).tolist():
                forest.union(x, y)
            if forest.parent:
                yield star_batch(forest)

    return run


def _blocks(crowd: DataFrame) -> DataFrame:
    """Rows of crowded regions of (id, n_shingles, keys, component) in pairs of blocks, sorted by _AT. The largest group of a region isn't compared within itself."""
    step = 2 * DEPTH
    at = crowd.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1)))).withColumn("prefix", F.conv(F.hex(F.expr(f"substring(keys, tree * {step} + 1, {2 * LEAST})")), 16, 10).cast("long"))
    groups = at.groupBy("tree", "prefix", "component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("size")).groupBy("tree", "prefix").agg(F.max(F.struct("n", "component", "size")).alias("most"), F.sum("n").alias("n"), F.sum("size").alias("size"), F.count("*").alias("groups"))
    many = lambda n, size: F.greatest(F.ceil(n / BLOCK), F.ceil(size / BLOCK_SHINGLES)).cast("int")
    regions = groups.where("groups > 1").select("tree", "prefix", F.col("most.component").alias("major"), many(F.col("most.n"), F.col("most.size")).alias("majors"), many(F.col("n") - F.col("most.n"), F.col("size") - F.col("most.size")).alias("minors"))
    rows = at.join(regions, ["tree", "prefix"]).withColumn("minor", F.col("component") != F.col("major"))
    rows = rows.withColumn("block", F.expr("cast(if(minor, pmod(xxhash64(id), minors), minors + pmod(xxhash64(id), majors)) as int)"))
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0, if(minor, minors + majors, minors) - 1)")))
    rows = rows.select("tree", "prefix", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "id", "component", "keys")
    return rows.repartition(shuffle_width(crowd.sparkSession), *_AT).sortWithinPartitions(*_AT)


def _crowd_links(crowd: DataFrame, sets: DataFrame, percent: int, made: list[DataFrame]) -> DataFrame:
    """(a, b): groups that links of crowded regions join, for documents (id, n_shingles, keys, component)."""
    asked = settle(_blocks(crowd).mapInArrow(_open, _OPEN), "open")
    made.append(asked)
    # a few rows go to the sets, which then move only where they are asked for
    few = asked.count() <= FEW
    held = sets.join(F.broadcast(asked), "id") if few else sets.join(asked, "id")
    held = held.repartition(shuffle_width(crowd.sparkSession), *_AT).sortWithinPartitions(*_AT)
    return held.select(*_AT, "block", "component", "set").mapInArrow(_joined(percent), "a long, b long")


def near_duplicate_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE_WORDS, percent: int = 75) -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept (one per component).

    Words are `[^\\x20\\x09-\\x0D]+` of the text with A-Z lower-cased. Documents with
    100 * intersection >= percent * union are linked. Texts with fewer than k words are one
    shingle; null texts and texts without words have none and link with nothing. Equal sets
    are one node, so copies cost no pairs. A null id links with nothing and isn't kept;
    repeated ids count as one document, by the least mark of their sets' (n_shingles is each
    row's own). Other columns are not read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    made: list[DataFrame] = []
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = settle(rows.mapInArrow(_signatures(k), "id long, n_shingles long, mark binary, keys binary"), "signatures")
    # an id that stands in several rows is one document, by the least of its marks
    repeated = settle(signed.where("id is not null").groupBy("id").agg(F.count("*").alias("rows"), F.min("mark").alias("least")).where("rows > 1").select("id", "least"), "repeated")
    n_repeated = repeated.count()
    marked = lookup(signed, repeated, "id", n_repeated).withColumn("by", F.coalesce("least", "mark")).drop("least") if n_repeated else signed.withColumn("by", F.col("mark"))
    own = F.when(F.col("id").isNotNull() & (F.col("mark") == F.col("by")), F.struct("id", "n_shingles", "keys"))
    nodes = marked.where("by is not null").groupBy(F.col("by").alias("mark")).agg(F.min(own).alias("first"), F.count("*").alias("rows")).where("first is not null").select("mark", "rows", "first.*")
    nodes = settle(nodes, "nodes")
    step = 2 * DEPTH
    order = nodes.select("id", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"), "keys")
    order = order.select("id", "tree", F.expr(f"substring(keys, tree * {step} + 1, {step})").alias("key"))
    order = order.repartitionByRange(shuffle_width(spark), "tree", "key", "id").sortWithinPartitions("tree", "key", "id")
    near = settle(order.mapInArrow(_neighbours(True), _PAIRS), "near")
    edges = near.where("border is not null").select("border", "place", "id", "tree", "key").repartition(shuffle_width(spark), "border").sortWithinPartitions("border", "place")
    across = edges.mapInArrow(_neighbours(False), _PAIRS).select("a", "b")
    found = settle(near.where("a is not null").select("a", "b").union(across).distinct(), "pairs")
    discard(near)
    pairs, crowd = found.where("a <> b"), found.where("a = b").select(F.col("a").alias("id"))
    wanted = found.select(F.col("a").alias("id")).union(found.select(F.col("b").alias("id"))).distinct()
    wanted = settle(wanted.join(nodes.select("id", "mark"), "id"), "wanted")
    bits = spark.sparkContext.broadcast(_filter(wanted))
    likely = rows.where("id is not null").withColumn("h", F.xxhash64("id")).mapInArrow(_sets(k, bits), "id long, mark binary, set binary")
    # without repeated ids no set stands twice, and the few that the filter let through meet no pair
    sets = likely.join(wanted, ["id", "mark"], "left_semi").select("id", "set").dropDuplicates(["id"]) if n_repeated else likely.select("id", "set")
    sets = settle(sets, "sets")
    checked = settle(_confirmed(pairs, sets, made), "checked")
    linked = F.expr(f"100 * shared >= {percent} * total")
    first = settle(components(checked.where(linked).select("a", "b")), "groups")
    # Pairs that were refused, though alike, go on to the hubs of each other's group.
    refused = checked.where(~linked & F.expr("3 * shared >= total"))
    of = first.select(F.col("node"), F.col("component"))
    ends = refused.join(of.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left").join(of.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
    ends = ends.select("a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb")).where("ca <> cb")
    both = checked.union(checked.select(F.col("b").alias("a"), F.col("a").alias("b"), "shared", "total"))
    likeness = both.groupBy("a").agg(F.avg(F.col("shared") / F.col("total")).alias("mean"), F.count("*").alias("n"))
    # the best of each of PARTS parts of a group, and of these the best HUBS: both are aggregated before they move
    ranked = of.join(likeness, F.col("node") == F.col("a")).select("component", "node", (F.col("mean") - 0.2 / F.sqrt("n")).alias("rank"))
    best = ranked.groupBy("component", F.pmod(F.xxhash64("node"), F.lit(PARTS)).alias("part")).agg(F.max(F.struct("rank", -F.col("node"))).alias("best"))
    hubs = best.groupBy("component").agg(F.slice(F.sort_array(F.collect_list("best"), asc=False), 1, HUBS).alias("best")).select("component", F.explode("best").alias("best")).select("component", (-F.col("best.col2")).alias("hub"))
    hubs = settle(hubs.join(settle(ends.select(F.explode(F.array("ca", "cb")).alias("component")).distinct(), "asked"), "component", "left_semi"), "hub_list")
    tries = ends.select(F.col("a").alias("x"), F.col("cb").alias("component")).union(ends.select(F.col("b").alias("x"), F.col("ca").alias("component"))).distinct()
    by_group = hubs.groupBy("component").agg(F.collect_list("hub").alias("hubs"))
    tries = lookup(tries, by_group, "component", by_group.count(), "inner").withColumn("hub", F.explode("hubs")).where("x <> hub").select(F.least("x", "hub").alias("a"), F.greatest("x", "hub").alias("b")).distinct().join(pairs, ["a", "b"], "left_anti")
    more = settle(_confirmed(tries, sets, made), "hubs")
    final = settle(components(first.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more.where(linked).select("a", "b"))), "groups")
    # Then all pairs of crowded regions that are left.
    crowded = settle(nodes.join(crowd, "id", "left_semi").select("id", "n_shingles", "keys"), "crowd")
    state = crowded.join(final, F.col("id") == F.col("node"), "left").select("id", "n_shingles", "keys", F.coalesce("component", "id").alias("component"))
    joined = settle(_crowd_links(state, sets, percent, made), "crowd_links")
    made.append(joined)
    if not joined.isEmpty():
        final = settle(components(final.select(F.col("node").alias("a"), F.col("component").alias("b")).union(joined)), "groups")
    # a row that shares its set with none and whose set is linked with none is its own group
    groups = nodes.join(final, F.col("id") == F.col("node"), "left").where("rows > 1 or component is not null")
    groups = settle(groups.select(F.col("mark").alias("by"), F.coalesce("component", "id").alias("component")), "classes")
    out = lookup(marked.select("id", "n_shingles", "by"), groups, "by", groups.count()).select(F.col("id").alias(id_col), "n_shingles", F.coalesce("component", "id").alias("component_id"))
    discard(found, wanted, sets, checked, first, hubs, crowded, *made)
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))
