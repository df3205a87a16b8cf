"""Embedding near-dedup by sorted projection passes.

Each pass orders the vectors of a label lexicographically by concatenated random
hyperplane signs, and a bounded window of neighbours in that order is verified by cosine
in double precision. Verified pairs are united across passes. A label's passes follow from
its size and from how often two of its vectors agree in a sign, so that a pair at the
threshold is missed in all passes with a chance of about `miss`. Where a window is half full
of vectors that lie close together, an order of signs doesn't tell them apart: such vectors
form crowds, and a crowd is compared wholly in blocks. Then the links inside each component
are counted exactly in blocks: no pair is ever emitted and no group meets in one task. Equal
vectors are one node with a weight.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Forest, components, discard, lookup, settle, shuffle_width, sorted_groups, star_batch

#: Signs of an order, and the least and most passes of a label. More are of no use: the windows of such a label are crowds.
SIGNS, LEAST_PASSES, MOST_PASSES = 48, 6, 40
#: Half a window of neighbours at this cosine is a crowd.
CLOSE = 0.75
_NODE = "node long, label string, width int, vec binary, weight long"


def passes_for(n: Column, alike: Column, window: int, threshold: float, miss: float) -> Column:
    """Passes after which a pair at the threshold has stood within a window once, but for a chance of `miss`.

    alike: the cosine that two vectors of the label have on average.
    """
    agree = 1 - math.acos(min(1.0, threshold)) / math.pi
    other = 1 - F.acos(F.greatest(F.lit(0.0), F.least(F.lit(CLOSE), alike))) / math.pi
    signs = F.greatest(F.lit(0.0), F.log(n / (window / 2)) / -F.log(other))
    near = F.least(F.lit(0.9), F.pow(F.lit(agree), signs))
    return F.greatest(F.lit(LEAST_PASSES), F.least(F.lit(MOST_PASSES), F.ceil(F.lit(math.log(miss)) / F.log(1 - near)))).cast("int")


def _planes(width: int, passes: int, seed: int) -> np.ndarray:
    return np.concatenate([np.random.default_rng([seed, width, p]).standard_normal((width, SIGNS)) for p in range(passes)], axis=1)


def _usable(kind: str):
    """Rows whose vectors are finite and not zero, the vector as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("vec")
            sizes = np.asarray(lists.value_lengths())
            for width in np.unique(sizes):
                at = np.flatnonzero(sizes == width)
                v = np.asarray(lists.take(pa.array(at)).flatten()).reshape(len(at), width)
                wide = v.astype(np.float64)
                ok = np.isfinite(wide).all(1) & (np.abs(wide).max(1, initial=0) > 0)
                at, v = pa.array(at[ok]), v[ok] + 0.0  # one zero, whatever its sign
                yield pa.RecordBatch.from_arrays([batch.column("id").take(at), batch.column("label").take(at), pa.array(np.full(len(v), width), pa.int32()), pa.array([x.tobytes() for x in v.astype(kind)], pa.binary())], names=["id", "label", "width", "vec"])

    return run


def unit_rows(blobs: pa.Array | pa.ChunkedArray, kind: str) -> np.ndarray:
    v = np.frombuffer(b"".join(blobs.to_pylist()), kind).reshape(len(blobs), -1).astype(np.float64)
    v /= np.abs(v).max(1)[:, None]
    return v / np.linalg.norm(v, axis=1)[:, None]


def _sums(kind: str):
    """Sums of the unit vectors of each label, by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sorted_groups(batches, ["label", "width"]):
            for i in range(0, table.num_rows, 4096):
                total = unit_rows(table["vec"].slice(i, 4096), kind).sum(0)
                n = min(4096, table.num_rows - i)
                width = len(total)
                yield pa.RecordBatch.from_arrays([pa.array([table["label"][0].as_py()] * width), pa.array([width] * width, pa.int32()), pa.array(range(width), pa.int32()), pa.array(total), pa.array([n] * width, pa.int64())], names=["label", "width", "place", "total", "n"])

    return run


def _keys(most: int, seed: int, kind: str):
    """Each row's order keys, one for each of its label's passes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = (1 << np.arange(SIGNS - 1, -1, -1)).astype(np.float64)
        for batch in batches:
            widths, passes = batch.column("width").to_numpy(), batch.column("passes").to_numpy()
            for width in np.unique(widths):
                for own in np.unique(passes[widths == width]):
                    at = pa.array(np.flatnonzero((widths == width) & (passes == own)))
                    some = batch.take(at)
                    signs = unit_rows(some.column("vec"), kind) @ _planes(int(width), int(own), seed) > 0
                    keys = (signs.reshape(len(at), own, SIGNS) @ weights).astype(np.int64)
                    lists = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, own, dtype=np.int32), keys.ravel())
                    yield pa.RecordBatch.from_arrays([*(some.column(c) for c in ("node", "label", "width", "vec")), lists], names=["node", "label", "width", "vec", "keys"])

    return run


_FOUND = "kind string, a long, b long, border int, pass int, label string, width int, place long, node long, vec binary"
_GROUP = ["pass", "label", "width"]
#: Added to the places of rows behind a border, so that those before it come first.
_AFTER = 1 << 40


def _windows(window: int, threshold: float, kind: str, borders: bool):
    """Of each row and its `window` next rows: verified pairs ('link') and neighbours of a crowd ('crowd'), united inside the partition.

    With `borders`, the first and the last rows of the partition are given too, for windows that reach into the next one.
    """
    kinds = ("link", "crowd")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        here = TaskContext.get().partitionId()
        forests = {k: Forest() for k in kinds}
        keys = _GROUP if borders else ["border", *_GROUP]
        place = 0
        last: list[pa.Table] = []

        def give(force: bool) -> Iterator[pa.RecordBatch]:
            for name in kinds:
                if force or len(forests[name].parent) > 300_000:
                    pairs = star_batch(forests[name])
                    n = pairs.num_rows
                    yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), *pairs.columns, *(pa.nulls(n, t) for t in (pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))], names=_names)
                    forests[name] = Forest()

        def edge(rows: pa.Table, border: int, after: int = 0) -> pa.RecordBatch:
            n = rows.num_rows
            rows = rows.set_column(rows.schema.get_field_index("place"), "place", pc.add(rows["place"], after))
            return pa.RecordBatch.from_arrays([pa.array(["edge"] * n, pa.string()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array([border] * n, pa.int32()), *(rows[c].combine_chunks() for c in ("pass", "label", "width", "place", "node", "vec"))], names=_names)

        for table in sorted_groups(batches, keys):
            n = table.num_rows
            if borders:
                table = table.append_column("place", pa.array(np.arange(place, place + n), pa.int64()))
                if place < window and here:
                    yield edge(table.slice(0, min(n, window - place)), here - 1, _AFTER)
                place += n
                last = [*last, table.slice(max(0, n - window))]
                while len(last) > 1 and sum(t.num_rows for t in last[1:]) >= window:
                    last.pop(0)
            ids, vecs = table["node"].to_numpy(), unit_rows(table["vec"], kind)
            for i in range(0, n, 256):
                s = vecs[i : i + 256] @ vecs[i : i + 256 + window].T
                step = np.arange(s.shape[1])[None, :] - np.arange(s.shape[0])[:, None]
                s[(step <= 0) | (step > window)] = -2
                r, c = np.nonzero(s >= threshold)
                for a, b in zip(ids[i + r].tolist(), ids[i + c].tolist(), strict=True):
                    forests["link"].union(a, b)
                close = s >= CLOSE
                full = np.flatnonzero(close.sum(1) * 2 >= window)
                r, c = np.nonzero(close[full])
                for a, b in zip(ids[i + full[r]].tolist(), ids[i + c].tolist(), strict=True):
                    forests["crowd"].union(a, b)
            yield from give(False)
        if last:
            rows = pa.concat_tables(last)
            yield edge(rows.slice(max(0, rows.num_rows - window)), here)
        yield from give(True)

    _names = [f.split()[0] for f in _FOUND.split(", ")]
    return run


def _blocks(rows: DataFrame, group: str, block: int) -> DataFrame:
    """Rows (group, node, vec, ...) dealt in blocks of a group: every pair of blocks meets in a row group (group, lo, hi)."""
    sizes = settle(rows.groupBy(group).agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    # a block grows with its group up to 16 times, so that the copies of a row do not
    sizes = sizes.select(group, F.ceil(F.col("n") / F.least(F.lit(16 * block), F.greatest(F.lit(block), F.floor(F.col("n") / 64)))).cast("int").alias("blocks"))
    dealt = lookup(rows, sizes, group, sizes.count(), "inner")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")}).drop("other", "blocks")
    return dealt.repartition(shuffle_width(rows.sparkSession), group, "lo", "hi").sortWithinPartitions(group, "lo", "hi")


def _crowd_links(threshold: float, kind: str):
    """Links inside the crowds, united inside the partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for table in sorted_groups(batches, ["component", "lo", "hi"]):
            block, ids, vecs = table["block"].to_numpy(), table["node"].to_numpy(), unit_rows(table["vec"], kind)
            a, b = np.flatnonzero(block == table["lo"][0].as_py()), np.flatnonzero(block == table["hi"][0].as_py())
            other = vecs[b].T
            for i in range(0, len(a), 256):
                r, c = np.nonzero(vecs[a[i : i + 256]] @ other >= threshold)
                for x, y in zip(ids[a[i + r]].tolist(), ids[b[c]].tolist(), strict=True):
                    forest.union(x, y)
            if len(forest.parent) > 500_000:
                yield star_batch(forest)
                forest = Forest()
        yield star_batch(forest)

    return run


def _counts(threshold: float, kind: str):
    """Rows linked to each node, its own copies not counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sorted_groups(batches, ["component", "lo", "hi"]):
            block, ids, weight = (table[c].to_numpy() for c in ("block", "node", "weight"))
            vecs = unit_rows(table["vec"], kind)
            lo, hi = table["lo"][0].as_py(), table["hi"][0].as_py()
            a, b = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
            other, mine, theirs = vecs[b].T, np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
            for i in range(0, len(a), 256):
                linked = vecs[a[i : i + 256]] @ other >= threshold
                linked &= ids[a[i : i + 256]][:, None] != ids[b][None, :]
                mine[i : i + 256] = linked @ weight[b]
                theirs += weight[a[i : i + 256]] @ linked
            if lo != hi:
                mine, a = np.concatenate([mine, theirs]), np.concatenate([a, b])
            yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(mine)], names=["node", "n"])

    return run


def near_duplicate_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label",
    threshold: float = 0.98, window: int = 64, miss: float = 1e-4, block: int = 512, seed: int = 7,
) -> DataFrame:
    """One row per input row: id, n_links, component_id, kept.

    Vectors are compared only when labels are equal and not null (label_col None: all with
    all) and lengths are equal. Vectors that are null, empty, zero, or hold null or
    non-finite components, and rows with a null id, link with nothing: n_links 0, their own
    component. Repeated rows of an id count once, by the least of their labels and vectors,
    and each get its result. Other columns are not read. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    kind = "<f4" if dict(vectors.dtypes)[vector_col] == "array<float>" else "<f8"
    width = shuffle_width(spark)
    label = F.col(label_col) if label_col else F.lit(0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), label.cast("string").alias("label"), F.col(vector_col).alias("vec"))
    rows = rows.where("label is not null and id is not null and vec is not null and size(vec) > 0 and not exists(vec, x -> x is null)")
    usable = rows.mapInArrow(_usable(kind), "id long, label string, width int, vec binary").groupBy("id").agg(F.min(F.struct("label", "width", "vec")).alias("v")).select("id", "v.*")
    usable = settle(usable.withColumn("digest", F.md5(F.concat_ws(":", F.col("label"), F.hex("vec")))), "usable")
    # equal vectors of a label are one node: summed before they are moved, and its least id is the node
    nodes = usable.groupBy("digest").agg(F.min("id").alias("node"), F.count("*").alias("weight"))
    nodes = settle(nodes, "nodes")
    held = settle(usable.join(nodes, F.col("node") == F.col("id")).select("node", "label", "width", "vec", "weight"), "held")
    sums = held.select("label", "width", "vec").sortWithinPartitions("label", "width").mapInArrow(_sums(kind), "label string, width int, place int, total double, n long")
    sums = sums.groupBy("label", "width", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).groupBy("label", "width").agg(F.sum(F.col("total") * F.col("total")).alias("square"), F.max("n").alias("n"))
    alike = (F.col("square") - F.col("n")) / (F.col("n") * (F.col("n") - 1))
    more = settle(sums.where(F.col("n") > window).select(F.concat_ws("/", "width", "label").alias("of"), passes_for(F.col("n"), alike, window, threshold, miss).alias("passes")).where(F.col("passes") > LEAST_PASSES), "passes")
    n_more, most = more.agg(F.count("*"), F.coalesce(F.max("passes"), F.lit(LEAST_PASSES))).first()
    keyed = held.withColumn("of", F.concat_ws("/", "width", "label"))
    keyed = lookup(keyed, more, "of", n_more).na.fill({"passes": LEAST_PASSES}) if n_more else keyed.withColumn("passes", F.lit(LEAST_PASSES))
    keyed = keyed.select("node", "label", "width", "vec", "passes").mapInArrow(_keys(most, seed, kind), "node long, label string, width int, vec binary, keys array<long>")
    ordered = keyed.select("node", "label", "width", "vec", F.posexplode("keys").alias("pass", "key")).withColumn("tie", F.xxhash64("node", "pass"))
    order = ["pass", "label", "width", "key", "tie"]
    ordered = ordered.repartitionByRange(width, *order).sortWithinPartitions(*order).select("pass", "label", "width", "node", "vec")
    found = settle(ordered.mapInArrow(_windows(window, threshold, kind, True), _FOUND), "windows")
    edges = found.where("kind = 'edge'").select("border", "pass", "label", "width", "place", "node", "vec")
    edges = edges.repartition(width, "border").sortWithinPartitions("border", "pass", "label", "width", "place")
    across = settle(edges.mapInArrow(_windows(window, threshold, kind, False), _FOUND), "borders")
    both = found.union(across)
    crowds = settle(components(both.where("kind = 'crowd'").select("a", "b")), "crowds")
    links = both.where("kind = 'link'").select("a", "b")
    crowded = _blocks(crowds.join(held.select("node", "label", "width", "vec"), "node"), "component", block).mapInArrow(_crowd_links(threshold, kind), "a long, b long")
    member = settle(components(links.union(crowded)), "members")
    discard(found, across, crowds)
    counted = _blocks(member.join(held.select("node", "vec", "weight"), "node"), "component", block).mapInArrow(_counts(threshold, kind), "node long, n long").groupBy("node").agg(F.sum("n").alias("n"))
    # nodes that stand alone have no links but their copies
    state = nodes.join(member, "node", "left").join(counted, "node", "left").where("weight > 1 or component is not null")
    state = settle(state.select("digest", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id")), "states")
    result = settle(lookup(usable.select(F.col("id").alias("of"), "digest"), state, "digest", state.count(), "inner").select("of", "n_links", "component_id"), "links")
    discard(usable, nodes, held, state, member, more)
    out = vectors.select(F.col(id_col).cast("long").alias(id_col)).join(result, F.col(id_col) == F.col("of"), "left")
    return out.select(id_col, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", id_col).alias("component_id")).withColumn("kept", F.coalesce(F.col("component_id") == F.col(id_col), F.lit(False)))
