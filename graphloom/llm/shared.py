"""Tables written to the folder that all executors share, and connected components over them."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset, one of our own, but only on a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.conf.get("graphloom.shared.dir", None)
        if not folder:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="graphloom-")
            spark.conf.set("graphloom.shared.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/graphloom-{uuid.uuid4().hex}/{name}"


#: Where a settled table lies, by the DataFrame that reads it.
_places: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write the rows to the shared folder and read them back: lineage ends here and a lost executor loses nothing."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    _places[back] = path
    return back


def discard(*tables: DataFrame) -> None:
    """Delete settled tables that nothing reads any more: all that was made of them must have been settled itself."""
    for df in tables:
        if path := _places.pop(df, None):
            context = df.sparkSession.sparkContext
            place = context._jvm.org.apache.hadoop.fs.Path(path).getParent()
            place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


#: Tables of up to FEW rows are broadcast by `lookup`; with larger ones, rows are dealt over SALT tasks a key.
FEW, SALT = 50_000, 16


def lookup(rows: DataFrame, table: DataFrame, key: str, n: int, how: str = "left", few: int = FEW) -> DataFrame:
    """`rows` with the columns of `table` that has at most one row for a key, n rows in all; a key of many rows is never gathered in one task."""
    if n <= few:
        return rows.join(F.broadcast(table), key, how)
    wide = table.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return rows.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALT)).cast("int")).join(wide, [key, "__salt"], how).drop("__salt")


_kept: dict[str, Any] = {}


def kept(name: str, make: Callable[[], Any]) -> Any:
    """What `make` gives. A worker keeps it for its later tasks, until it is asked for another name."""
    if name not in _kept:
        release()
        _kept[name] = make()
    return _kept[name]


def release() -> None:
    """Let go of what this worker keeps, and give back memory that earlier tasks left unused: a worker outlives the stage it was started for."""
    _kept.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


#: Bytes and rows of a batch that moves between the JVM and a worker. Spark's own are eight and five times as large, for each of several copies.
BATCH = {"spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20), "spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}


def small_batches(spark: SparkSession) -> None:
    """Texts and sets are wide rows: keep batches of them small in this session."""
    for name, value in BATCH.items():
        spark.conf.set(name, value)


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of equal keys of a partition that is sorted by them, one table each, across batch borders."""
    held: list[pa.Table] = []
    last: tuple | None = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        change = np.zeros(n, bool)
        change[0] = True
        for k in keys:
            v = batch.column(k).to_numpy(zero_copy_only=False)
            change[1:] |= v[1:] != v[:-1]
        cuts = [*np.flatnonzero(change).tolist(), n]
        table = pa.Table.from_batches([batch])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(batch.column(k)[a].as_py() for k in keys)
            if key != last and held:
                yield pa.concat_tables(held)
                held = []
            last = key
            held.append(table.slice(a, b - a))
    if held:
        yield pa.concat_tables(held)


class Forest:
    """Union-find over integers; a root is the smallest member."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        p = self.parent
        p.setdefault(x, x)
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    def union(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True

    def stars(self) -> list[tuple[int, int]]:
        return [(x, r) for x in list(self.parent) if (r := self.root(x)) != x]


def star_batch(forest: Forest) -> pa.RecordBatch:
    pairs = forest.stars()
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([r for _, r in pairs], pa.int64())], names=["a", "b"])


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forest = Forest()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            forest.union(a, b)
        if len(forest.parent) > 2_000_000:  # a worker's memory stays bounded; later rounds go on from the stars
            yield star_batch(forest)
            forest = Forest()
    yield star_batch(forest)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of an edge list (a long, b long); a component is its smallest node.

    Edges are first contracted inside partitions, then large-star and small-star rounds run
    until the edges stay as they are. A round holds only a minimum per node, so a node with
    many neighbours never gathers them in one place. Nulls and self-links are ignored; an
    empty list gives an empty table.
    """
    now = settle(edges.where("a is not null and b is not null and a <> b").mapInArrow(_contract, "a long, b long"), "edges")
    state = None
    while True:
        found = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == tuple(found) or not found["n"]:
            break
        state = tuple(found)
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = settle(large, "large")
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(down.withColumnRenamed("a", "k"), F.col("a") == F.col("k")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = settle(moved.union(down.select("a", F.col("m").alias("b"))).distinct(), "edges")
        discard(now, large)
        now = after
    return now.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component").union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


Batches = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
