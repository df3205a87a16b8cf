"""Tables of a code map from its files, and the targets of its imports."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, reduce
from itertools import accumulate, chain
from operator import attrgetter, itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import languages as lg
from .source import parse

_SYMBOL = "name string, kind string, parent string, signature string, start_line long, end_line long, visibility string, doc string, doc_source string"
PARSED = f"path string, lang string, size long, hash string, is_test boolean, doc string, symbols array<struct<{', '.join(p.replace(' ', ': ', 1) for p in _SYMBOL.split(', '))}>>, imports array<string>, refs array<struct<line: long, name: string>>"
_FIELDS = [p.split()[0] for p in _SYMBOL.split(", ")]


def _lists(parts: list[list], values: pa.Array) -> pa.ListArray:
    """One list a part over the values of all parts in a row."""
    return pa.ListArray.from_arrays(pa.array([0, *accumulate(map(len, parts))], pa.int32()), values)


def _structs(rows: list, columns: dict[str, tuple]) -> pa.StructArray:
    return pa.StructArray.from_arrays([pa.array([get(r) for r in rows], kind) for get, kind in columns.values()], names=list(columns))


_SYMBOL_COLUMNS = {f: (attrgetter(f), pa.int64() if f.endswith("_line") else pa.string()) for f in _FIELDS}
_CALL_COLUMNS = {"line": (itemgetter(0), pa.int64()), "name": (itemgetter(1), pa.string())}


def _parse_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 64):  # files are parsed a few at a time, so results stay small
            some = batch.slice(at, 64)
            found = [parse(t or "", lang) for t, lang in zip(some.column("text").to_pylist(), some.column("lang").to_pylist(), strict=True)]
            symbols, refs = [p.symbols for p in found], [p.refs for p in found]
            lists = [_lists(symbols, _structs(list(chain(*symbols)), _SYMBOL_COLUMNS)), pa.array([p.imports for p in found], pa.list_(pa.string())), _lists(refs, _structs(list(chain(*refs)), _CALL_COLUMNS))]
            columns = [*(some.column(c) for c in ("path", "lang", "size", "hash", "is_test")), pa.array([p.doc for p in found], pa.string()), *lists]
            yield pa.RecordBatch.from_arrays(columns, names=["path", "lang", "size", "hash", "is_test", "doc", "symbols", "imports", "refs"])


def directory(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_extract(path, r"^(.*)/[^/]*$", 1)).otherwise(F.lit(""))


def name_of(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


@dataclass
class CodeMap:
    """A code map over files (path, lang, text): each table is declared on `parsed`, one row per file.

    Store `parsed` once (`stored`) and every query reads only the columns that it needs.
    """

    sources: DataFrame
    parsed: DataFrame

    @classmethod
    def of(cls, sources: DataFrame) -> CodeMap:
        rows = sources.select("path", "lang", "text", F.octet_length("text").cast("long").alias("size"), F.md5("text").alias("hash"), lg.is_test(F.col("path"), F.col("lang")).alias("is_test"))
        return cls(sources, rows.mapInArrow(_parse_all, PARSED))

    def stored(self, path: str) -> CodeMap:
        """The same map with its parsed rows written once, dealt by path."""
        self.parsed.write.mode("overwrite").parquet(path)
        return CodeMap(self.sources, self.parsed.sparkSession.read.schema(PARSED).parquet(path))

    @cached_property
    def files(self) -> DataFrame:
        return self.parsed.select("path", directory(F.col("path")).alias("dir"), "lang", "hash", "size", "doc", "is_test")

    @cached_property
    def symbols(self) -> DataFrame:
        return self.parsed.select("path", F.posexplode("symbols").alias("id", "s")).select("path", (F.col("id") + 1).cast("long").alias("id"), "s.*")

    @cached_property
    def refs(self) -> DataFrame:
        return self.parsed.select("path", F.explode("refs").alias("r")).select("path", "r.line", "r.name")

    @cached_property
    def targets(self) -> DataFrame:
        return self.parsed.select("path", "lang", F.explode("imports").alias("target"))

    @cached_property
    def lines(self) -> DataFrame:
        text = F.regexp_replace("text", r"\n\z", "")
        rows = self.sources.select("path", F.posexplode(F.split(text, "\n")).alias("i", "line_text"))
        return rows.select("path", (F.col("i") + 1).cast("long").alias("line"), F.regexp_replace("line_text", r"\r\z", "").alias("line_text"))

    @cached_property
    def imports(self) -> DataFrame:
        return self._resolved(self.targets)

    @cached_property
    def test_imports(self) -> DataFrame:
        """The imports of test files. What one names doesn't hang on others, so only these are resolved."""
        return self._resolved(self.parsed.where("is_test").select("path", "lang", F.explode("imports").alias("target")))

    def _resolved(self, targets: DataFrame) -> DataFrame:
        from . import aliases

        relative, of_crates = aliases.crate_imports(targets, self.files, self.sources)
        return resolve(targets, self.files, modules(self.sources), (aliases.bare_imports(targets, self.files, self.sources), relative), of_crates)


def modules(sources: DataFrame) -> DataFrame:
    """Modules that a go.mod declares: (module, root)."""
    found = sources.where(name_of(F.col("path")) == "go.mod").select(F.regexp_extract("text", r"(?m)^module\s+(\S+)", 1).alias("module"), directory(F.col("path")).alias("root"))
    return found.where("module <> ''").distinct()


def normal_path(path: Column) -> Column:
    """A path without `.` and `..` steps; null where it leaves the tree."""
    step = F.aggregate(
        F.split(path, "/"), F.array().cast("array<string>"),
        lambda out, x: F.when((x == "") | (x == "."), out).when((x == "..") & (F.size(out) > 0) & (F.element_at(out, -1) != ".."), F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(F.concat(out, F.array(x))),
    )
    return F.when(F.startswith(path, F.lit("/")) | (F.get(step, F.lit(0)) == ".."), F.lit(None)).otherwise(F.array_join(step, "/"))


def join_path(a: Column, b: Column) -> Column:
    return F.when(a == "", b).otherwise(F.concat(a, F.lit("/"), b))


def shared_steps(a: Column, b: Column) -> Column:
    """Leading folders that two paths share."""
    x, y = F.split(a, "/"), F.split(b, "/")
    same = F.zip_with(x, y, lambda p, q: p.eqNullSafe(q))
    first = F.array_position(same, F.lit(False))
    return F.when(first == 0, F.size(same)).otherwise(first - 1).cast("int")


def _choices(base: Column, x: lg.Language) -> Column:
    """Files that a path without its extension may name, in order."""
    return F.array(*[F.concat(base, F.lit(e)) for e in x.tries], *[join_path(base, F.lit(p)) for p in x.package_files])


def named_files(base: Column, x: lg.Language) -> Column:
    """Files that a path as written may name, in order: itself, what its ending stands for, with an ending, as a folder."""
    ext = F.regexp_extract(base, r"(\.[^./]+)$", 1)
    stem = F.regexp_replace(base, r"\.[^./]+$", "")
    names = F.array(base)
    for old, new in x.stand_ins.items():
        names = F.concat(names, F.when(ext == old, F.array(*[F.concat(stem, F.lit(n)) for n in new])).otherwise(F.array().cast("array<string>")))
    return F.concat(names, _choices(base, x))


def _relative(targets: DataFrame) -> DataFrame:
    """(path, lang, target, rank, file): candidates of paths that start at the importer."""
    parts = []
    here = directory(F.col("path"))
    plain = [x.name for x in lg.LANGUAGES if x.strategy == "path" and not x.tries]
    for x in lg.LANGUAGES:
        own = targets.where(F.col("lang").isin(*plain) if x.name == plain[0] else F.col("lang") == x.name)
        if x.strategy == "path" and x.name not in plain[1:]:
            base = normal_path(join_path(here, F.col("target")))
            found = own.where(F.rlike("target", F.lit(r"^\.\.?(/|$)"))).withColumn("names", named_files(base, x))
            parts.append(found.select("path", "lang", "target", F.posexplode("names").alias("rank", "file")))
        elif x.strategy == "module" and x.name == "python":
            dots = F.length(F.regexp_extract("target", r"^(\.+)", 1))
            anchor = normal_path(join_path(here, F.array_join(F.array_repeat(F.lit(".."), (dots - 1).cast("int")), "/")))
            rest = F.filter(F.split(F.regexp_replace("target", r"^\.+", ""), r"\."), lambda p: F.rlike(p, F.lit(r"^\w+$")))
            heads = F.transform(F.when(F.size(rest) > 0, F.sequence(F.size(rest), F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>")), lambda n: join_path(anchor, F.array_join(F.slice(rest, 1, n), "/")))
            names = F.concat(F.flatten(F.transform(heads, lambda h: _choices(h, x))), F.array(*[join_path(anchor, F.lit(p)) for p in x.package_files]))
            parts.append(own.where(F.startswith("target", F.lit("."))).withColumn("names", names).select("path", "lang", "target", F.posexplode("names").alias("rank", "file")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def tail(path: Column) -> Column:
    """The last two names of a path."""
    return F.regexp_extract(path, r"((?:[^/]*/)?[^/]*)$", 1)


def _suffixes(targets: DataFrame) -> DataFrame:
    """(path, lang, target, n, wanted): for every module name its endings of paths, whole names, then longer ones first."""
    parts = []
    for x in lg.LANGUAGES:
        if x.strategy == "module":
            sep = x.separator.replace(".", r"\.")
            # `self` and `super` start at the importer; what stands before a crate's own names is left out, if two stay
            lead = r"(?:crate::)?(?!(?:crate|self|super)(?:::|$))" if x.name == "rust" else ""
            named = targets.where(F.col("lang") == x.name).select("path", "lang", "target", F.regexp_extract("target", rf"^{lead}(\w+(?:{sep}\w+)*)(?={sep}|$)", 1).alias("named")).where("named <> ''")
            names = F.split("named", sep)
            starts = F.sequence(F.lit(0), F.greatest(F.size(names) - 2, F.lit(0))) if x.name == "rust" else F.array(F.lit(0))
            begun = named.select("path", "lang", "target", names.alias("names"), F.explode(starts).alias("start"))
            lengths = F.sequence(F.size("names") - F.col("start"), F.when(F.col("start") > 0, 2).otherwise(1), F.lit(-1))
            heads = begun.select("path", "lang", "target", "names", "start", F.explode(lengths).alias("n"))
            based = heads.select("path", "lang", "target", F.struct("start", (-F.col("n")).alias("n")).alias("n"), F.array_join(F.slice("names", F.col("start") + 1, F.col("n")), "/").alias("base"))
            parts.append(based.select("path", "lang", "target", "n", F.explode(_choices(F.col("base"), x)).alias("wanted")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def resolve(targets: DataFrame, files: DataFrame, go_modules: DataFrame, declared: tuple[DataFrame, ...] = (), otherwise: DataFrame | None = None) -> DataFrame:
    """(path, target, resolved): the file, or for Go the folder, that an import names; null for one outside the tree or of itself.

    `declared` are tables of imports that no rule of paths or module names reads, `otherwise` one
    of those that count where these rules find nothing.

    Every join is on whole names or on the last two of them, so no table meets another as a whole.
    """
    known = files.select(F.col("path").alias("file"), F.col("lang").alias("file_lang"))
    exact = _relative(targets).join(known.select("file"), "file", "left_semi").groupBy("path", "target").agg(F.min_by("file", "rank").alias("resolved"))

    packages = files.select(F.explode(F.array(*[F.when(name_of(F.col("path")) == p, F.struct("lang", F.col("dir").alias("root"))) for p in ("__init__.py", "package-info.java", "mod.rs")])).alias("p")).where("p is not null").select("p.lang", "p.root").distinct()
    wanted = _suffixes(targets).withColumn("tail", tail(F.col("wanted")))
    nested = known.withColumn("tail", tail(F.col("file"))).withColumn("plain", name_of(F.col("file")))
    fits = ((F.col("file") == F.col("wanted")) | F.endswith("file", F.concat(F.lit("/"), F.col("wanted")))) & (F.col("lang") == F.col("file_lang"))
    long_ = wanted.where(F.contains("wanted", F.lit("/"))).join(nested.drop("plain"), "tail").where(fits)
    lone = wanted.where(~F.contains("wanted", F.lit("/"))).drop("tail").join(nested.drop("tail"), F.col("plain") == F.col("wanted")).where(fits)
    hits = long_.select("path", "lang", "target", "n", "wanted", "file").withColumn("nested", F.lit(True)).unionByName(lone.select("path", "lang", "target", "n", "wanted", "file").withColumn("nested", F.lit(False)))
    hits = hits.withColumn("root", F.regexp_replace(F.expr("substring(file, 1, length(file) - length(wanted))"), "/$", ""))
    # a root that is a package itself means that the file's own module path is longer
    hits = hits.join(packages, ["lang", "root"], "left_anti")
    here = directory(F.col("path"))
    reachable = F.col("nested") | (F.col("root") == "") | (here == F.col("root")) | F.startswith(here, F.concat(F.col("root"), F.lit("/"))) | ((F.col("lang") == "python") & name_of(F.col("root")).isin("src"))
    order = F.struct("n", -shared_steps(directory(F.col("file")), here), F.length("file"), F.col("file"))
    by_name = hits.where(reachable).groupBy("path", "target").agg(F.min_by("file", order).alias("resolved"))

    # a module that an import lies in is one of the import's own beginnings
    steps = F.split("target", "/")
    within = targets.where("lang = 'go'").withColumn("module", F.explode(F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, F.lit(1), n), "/"))))
    rooted = within.join(go_modules, "module")
    rest = F.regexp_replace(F.expr("substring(target, length(module) + 1, length(target))"), "^/+|/+$", "")
    rooted = rooted.withColumn("folder", F.coalesce(normal_path(join_path(F.col("root"), rest)), F.lit("")))
    nearest = rooted.groupBy("path", "target").agg(F.max_by("folder", F.length("module")).alias("folder"))
    folders = files.where("lang = 'go'").select(F.col("dir").alias("folder")).distinct()
    by_folder = nearest.join(folders, "folder", "left_semi").select("path", "target", F.col("folder").alias("resolved"))

    if otherwise is not None:
        by_name = by_name.unionByName(otherwise.join(by_name, ["path", "target"], "left_anti"))
    found = reduce(DataFrame.unionByName, declared, exact.unionByName(by_name).unionByName(by_folder)).where("path <> resolved")
    return targets.select("path", "target").distinct().join(found, ["path", "target"], "left")
