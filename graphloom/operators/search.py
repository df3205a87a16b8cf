"""Ranked symbol search and point lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fold


def match_tier(name: Column, doc: Column, needle: str) -> Column:
    """0 exact, 1 exact but for ASCII case, 2 beginning, 3 inside, 4 only in the documentation; null for none."""
    low = needle.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return F.when(name == needle, 0).when(fold(name) == low, 1).when(F.startswith(fold(name), F.lit(low)), 2).when(F.contains(fold(name), F.lit(low)), 3).when(F.contains(fold(doc), F.lit(low)), 4)


def find_symbol(symbols: DataFrame, files: DataFrame, needle: str, kind: str | None = None, limit: int = 50) -> DataFrame:
    """The best `limit` symbols by tier, tests last, short names first, then path and place."""
    s = symbols.withColumn("tier", match_tier(F.col("name"), F.col("doc"), needle)).where("tier is not null")
    if kind:
        s = s.where(F.col("kind") == kind)
    return s.join(files.select("path", "is_test"), "path").orderBy("tier", "is_test", F.length("name"), "path", "start_line", "id").limit(limit)


def exact_symbols(symbols: DataFrame, name: str) -> DataFrame:
    """Symbols of the name by case; only where there are none, without ASCII case."""
    hits = symbols.withColumn("tier", match_tier(F.col("name"), F.lit(None).cast("string"), name)).where("tier <= 1")
    best = hits.agg(F.min("tier").alias("best"))
    return hits.join(F.broadcast(best), F.col("tier") == F.col("best")).drop("best")


def shortest_first(values: DataFrame, column: str, limit: int = 10) -> DataFrame:
    return values.orderBy(F.length(column), column).limit(limit)


#: Lines of a block. A line meets only the intervals that reach into its block, so a long file is no single key.
BLOCK = 256


def in_blocks(intervals: DataFrame) -> DataFrame:
    """One row for each block that an interval [start_line, end_line] reaches into."""
    return intervals.withColumn("block", F.explode(F.sequence(F.floor(F.col("start_line") / BLOCK), F.floor(F.col("end_line") / BLOCK))))


def enclosing(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """Each call with the innermost symbol around it, or nulls: the shortest interval, then the latest start, then the last id."""
    s = in_blocks(symbols.select("path", F.col("name").alias("symbol"), "start_line", "end_line", "id"))
    hit = refs.withColumn("block", F.floor(F.col("line") / BLOCK)).join(s, ["path", "block"], "left")
    order = F.struct(F.col("start_line") - F.col("end_line"), F.col("start_line"), F.col("id"))
    best = F.max_by(F.struct("symbol", "start_line"), F.when(F.col("line").between(F.col("start_line"), F.col("end_line")), order))
    return hit.groupBy("path", "name", "line").agg(best.alias("b")).select("path", "name", "line", F.col("b.symbol").alias("symbol"), F.col("b.start_line").alias("start_line"))


def calls_inside(refs: DataFrame, symbols: DataFrame, kind: str) -> DataFrame:
    """Calls that lie in a symbol of the kind: a semi join with the merged intervals of the kind, by blocks of lines."""
    s = in_blocks(merged_spans(symbols.where(F.col("kind") == kind))).withColumnsRenamed({"path": "p", "block": "b"})
    r = refs.withColumn("block", F.floor(F.col("line") / BLOCK))
    return r.join(s, (F.col("path") == F.col("p")) & (F.col("block") == F.col("b")) & F.col("line").between(F.col("start_line"), F.col("end_line")), "left_semi").drop("block")


def merged_spans(spans: DataFrame, before: int = 0, after: int = 0) -> DataFrame:
    """Overlapping or touching [start_line - before, end_line + after] of each path as one span."""
    w = Window.partitionBy("path").orderBy("a", "b")
    s = spans.select("path", F.greatest(F.col("start_line") - before, F.lit(1)).alias("a"), (F.col("end_line") + after).alias("b"))
    s = s.withColumn("reach", F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    s = s.withColumn("island", F.sum(F.when(F.col("a") > F.col("reach") + 1, 1).otherwise(0)).over(w))
    return s.groupBy("path", "island").agg(F.min("a").alias("start_line"), F.max("b").alias("end_line")).drop("island")


def islands(flagged: DataFrame, flag: Column) -> DataFrame:
    """Runs of consecutive lines that have the flag."""
    f = flagged.where(flag)
    f = f.withColumn("g", F.col("line") - F.row_number().over(Window.partitionBy("path").orderBy("line")))
    return f.groupBy("path", "g").agg(F.min("line").alias("first_line"), F.max("line").alias("last_line")).drop("g")


def shifted_lines(lines: DataFrame, deleted: DataFrame) -> DataFrame:
    """Line numbers after the deleted ones before them are gone."""
    d = deleted.select("path", F.col("line").alias("d"), F.lit(1).alias("gone"))
    both = lines.select("path", "line").join(d, (lines["path"] == d["path"]) & (lines["line"] == d["d"]), "left").select(lines["path"], "line", F.coalesce("gone", F.lit(0)).alias("gone"))
    w = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    return both.withColumn("new_line", F.col("line") - F.coalesce(F.sum("gone").over(w), F.lit(0))).where("gone = 0").select("path", "line", "new_line")
