"""Import edges, directories, tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def importers_of(imports: DataFrame, keys: list[str]) -> DataFrame:
    return imports.where(F.col("resolved").isin(keys)).select("path", "target").distinct()


def importers_under(imports: DataFrame, top: str) -> DataFrame:
    return imports.where((F.col("resolved") == top) | F.startswith("resolved", F.lit(top + "/"))).select("path", "target").distinct()


def importers_of_module(imports: DataFrame, separators: DataFrame, module: str) -> DataFrame:
    """Importers whose target is the module or begins with it and their language's separator (lang, sep)."""
    return imports.join(separators, "lang", "left").where((F.col("target") == module) | F.startswith("target", F.concat(F.lit(module), F.coalesce("sep", F.lit("/"))))).select("path", "target").distinct()


def targets_by_importer(edges: DataFrame) -> DataFrame:
    return edges.groupBy("path").agg(F.array_sort(F.collect_set("target")).alias("targets"))


def directory_stats(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Files and symbols of each directory; files without symbols count."""
    n = symbols.groupBy("path").agg(F.count("*").alias("n"))
    return files.join(n, "path", "left").groupBy("dir").agg(F.count("*").alias("files"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("symbols"))


def purposes(candidates: DataFrame) -> DataFrame:
    """(dir, rank, path, doc): the documentation of least rank, then path, per directory."""
    return candidates.where("doc is not null").groupBy("dir").agg(F.min_by("doc", F.struct("rank", "path")).alias("doc"))


def closest_sources(tests: DataFrame, sources: DataFrame) -> DataFrame:
    """For each test (path, key), the sources of its key that share most leading and trailing directories; ties stay."""
    parts = lambda c: F.slice(F.split(c, "/"), 1, F.size(F.split(c, "/")) - 1)

    def shared(a, b):
        n = F.least(F.size(a), F.size(b))
        return F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), lambda acc, i: F.when((acc == i - 1) & F.get(a, i - 1).eqNullSafe(F.get(b, i - 1)) & (i <= n), acc + 1).otherwise(acc))

    pairs = tests.select(F.col("path").alias("test"), "key").join(sources.select(F.col("path").alias("source"), "key"), "key")
    a, b = parts(F.col("test")), parts(F.col("source"))
    pairs = pairs.withColumn("score", shared(a, b) + shared(F.reverse(a), F.reverse(b)))
    best = F.rank().over(Window.partitionBy("test").orderBy(F.desc("score")))
    return pairs.withColumn("r", best).where("r = 1").select("test", "source", "score")


def ancestors(paths: DataFrame, column: str = "path") -> DataFrame:
    """Every directory above a path with its depth; the root is ''."""
    parts = F.split(column, "/")
    up = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.struct(F.array_join(F.slice(parts, 1, i), "/").alias("dir"), i.alias("depth")))
    return paths.select(column, F.explode(up).alias("u")).select(column, "u.dir", "u.depth")


def nearest_config(paths: DataFrame, configs: DataFrame) -> DataFrame:
    """The deepest directory above each path that has a configuration (dir)."""
    return ancestors(paths).join(configs.select("dir"), "dir").groupBy("path").agg(F.max_by("dir", "depth").alias("dir"))


def longest_prefix(targets: DataFrame, modules: DataFrame) -> DataFrame:
    """For each target the longest module that is it or above it: equi join on exploded ancestors, never a prefix scan."""
    up = targets.select("target", F.concat("target", F.lit("/x")).alias("path"))
    found = ancestors(up).withColumnRenamed("dir", "module").join(up, "path").join(modules.select("module"), "module")
    return found.groupBy("target").agg(F.max_by("module", "depth").alias("module"))


def anti_inside(edges: DataFrame, top: str) -> DataFrame:
    """Edges that do not begin under the directory."""
    return edges.where(~((F.col("path") == top) | F.startswith("path", F.lit(top + "/"))))


def tests_in_package(files: DataFrame) -> DataFrame:
    """(test, source): every test file with every other file of its directory and language."""
    tests = files.where("is_test").select(F.col("path").alias("test"), "dir", "lang")
    return tests.join(files.select(F.col("path").alias("source"), "dir", "lang"), ["dir", "lang"]).where("test <> source").select("test", "source")


def tests_in_package_counts(files: DataFrame) -> DataFrame:
    """Each test with its folder and how many other files that folder holds: what it tests, without a row for every pair."""
    held = files.groupBy("dir").agg((F.count("*") - 1).alias("sources"))
    return files.where("is_test").select(F.col("path").alias("test"), "dir").join(held, "dir").where("sources > 0").select("test", "dir", "sources")
