"""Context packs: what a code map knows about the names in prompts, within a budget of tokens.

All prompts are answered together, those that ask the same once. Different names are looked up once, by joins on whole keys:
a path by the file's or folder's path or by an ending of it, a symbol by its name. What a name
gives is cut to a few lines before prompts meet it, so a prompt gathers a bounded number of
lines; these fill its budget in order, and a line that doesn't fit leaves room for a shorter one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..extraction.tables import CodeMap, name_of, normal_path
from ..functions.text import estimate_tokens
from ..session import settled
from . import prompts as pr
from . import tools

#: Lines that a name may give, and words for kinds of symbols.
SYMBOL_HITS, OUTLINE_LINES, FOLDER_FILES, TESTS, TESTED_FILES, SUGGESTIONS = 4, 12, 12, 3, 6, 3
KIND_LABELS = {"function": "fn", "constant": "const", "variable": "var"}
HEADER = "From the code map, for the names in this prompt:"
#: How alike a misspelt name is to the one meant, and the shortest one that is looked at.
ALIKE, LEAST_NAME = 0.8, 4


def _first(rows: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each key with their `place`; Spark keeps n of each already before it moves them."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= n)


def _label(kind: Column) -> Column:
    out = kind
    for name, word in KIND_LABELS.items():
        out = F.when(kind == name, word).otherwise(out)
    return out


def _with_doc(line: Column, doc: Column) -> Column:
    return F.when(doc.isNull() | (doc == ""), line).otherwise(F.concat(line, F.lit(" — "), doc))


def named(prompts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, at, name, kind, path, needle, parent) of the names that prompts mention, in order."""
    found = pr.classified(prompts, id_col, text_col).select(F.col(id_col).alias("id"), F.posexplode("names").alias("at", "n")).select("id", "at", F.col("n.text").alias("name"), F.col("n.kind").alias("kind"))
    path = normal_path(F.regexp_replace(F.translate("name", "\\", "/"), "^/+", ""))
    parts = F.filter(F.split(F.regexp_replace("name", r"\(\)$", ""), r"\.|::|#"), lambda p: p != "")
    return found.withColumn("path", F.nullif(path, F.lit(""))).withColumn("needle", F.element_at(parts, -1)).withColumn("parent", F.when(F.size(parts) > 1, F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), ".")))


def symbols_of(names: DataFrame, index: CodeMap) -> DataFrame:
    """(name, place, path, start_line, end_line, kind, shown, doc, is_test): the first symbols of each name, of the named parent where it has them."""
    wanted = names.where("needle is not null").select("name", "needle", "parent").distinct()
    files = index.files.select("path", "is_test")
    hits = wanted.withColumnRenamed("parent", "under").join(index.symbols, F.col("needle") == index.symbols["name"]).drop(index.symbols["name"])
    fits = F.col("under").isNotNull() & F.coalesce((F.col("parent") == F.col("under")) | F.endswith("parent", F.concat(F.lit("."), F.col("under"))), F.lit(False))
    hits = hits.withColumn("fits", fits)
    best = hits.groupBy("name").agg(F.max("fits").alias("any_fits"))
    hits = hits.join(best, "name").where("fits or not any_fits").join(files, "path")
    hits = _first(hits, ["name"], ["is_test", "path", "start_line", "id"], SYMBOL_HITS)
    return hits.select("name", "place", "path", "start_line", "end_line", "kind", tools.shown_signature("signature", "needle", "parent").alias("shown"), tools.doc_summary("doc").alias("doc"), "is_test")


def endings(path: Column) -> Column:
    """A path's own endings: it without one, two, ... of its first folders."""
    steps = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, n, F.size(steps)), "/"))


def paths_of(names: DataFrame, index: CodeMap) -> DataFrame:
    """(path, file, folder, ending): the file or the folder that a path is, else the first files that it is the ending of."""
    wanted = names.where("path is not null").select("path").distinct()
    files = index.files.select(F.col("path").alias("file"), "dir")
    exact = wanted.join(files, F.col("path") == F.col("file")).select("path", "file")
    steps = F.split("dir", "/")
    folders = files.select("dir").distinct().select(F.explode(F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, F.lit(1), n), "/"))).alias("folder")).where("folder <> ''").distinct()
    folder = wanted.join(exact, "path", "left_anti").join(folders, F.col("path") == F.col("folder")).select("path", "folder")
    rest = wanted.join(exact, "path", "left_anti").join(folder, "path", "left_anti")
    # of the files' endings only those of a wanted last name are made
    near = files.select("file").withColumn("last", name_of(F.col("file"))).join(rest.select(name_of(F.col("path")).alias("last")).distinct(), "last", "left_semi")
    ends = near.select("file", F.explode(endings(F.col("file"))).alias("path")).join(rest, "path")
    ends = _first(ends, ["path"], [F.length("file"), "file"], TESTS)
    none = F.lit(None).cast("string")
    return exact.select("path", "file", none.alias("folder"), none.alias("ending")).union(folder.select("path", none, "folder", none)).union(ends.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "file"))), lambda x: x["file"]), ", ").alias("ending")).select("path", none, none, "ending"))


def _outlines(files: DataFrame, index: CodeMap) -> DataFrame:
    """(file, row, line): a head and the first symbols of each file."""
    symbols = index.symbols.withColumnRenamed("path", "file").join(files, "file", "left_semi")
    counts = symbols.groupBy("file").agg(F.count("*").alias("n"))
    heads = index.files.select(F.col("path").alias("file"), "lang", tools.doc_summary("doc").alias("doc")).join(files, "file", "left_semi").join(counts, "file", "left")
    n = F.coalesce("n", F.lit(0))
    head = heads.select("file", F.lit(0).alias("row"), _with_doc(F.concat(F.lit("- "), "file", F.lit(" ("), F.coalesce("lang", F.lit("no parser")), F.lit(", "), n.cast("string"), F.lit(" symbols)")), F.col("doc")).alias("line"))
    more = counts.where(F.col("n") > OUTLINE_LINES).select("file", F.lit(OUTLINE_LINES + 1).alias("row"), F.concat(F.lit("  … "), (F.col("n") - OUTLINE_LINES).cast("string"), F.lit(" more")).alias("line"))
    shown = _first(symbols, ["file"], ["start_line", F.desc("end_line"), "id"], OUTLINE_LINES)
    line = F.concat(F.when(F.col("parent").isNull(), "  L").otherwise("    L"), F.col("start_line").cast("string"), F.lit(" "), _label(F.col("kind")), F.lit(" "), tools.shown_signature("signature", "name", "parent"))
    return head.union(shown.select("file", F.col("place").alias("row"), line.alias("line"))).union(more)


def _folders(folders: DataFrame, index: CodeMap) -> DataFrame:
    """(folder, line): the names of a folder's own files."""
    files = index.files.select(F.col("dir").alias("folder"), "path").join(folders, "folder", "left_semi")
    counts = files.groupBy("folder").agg(F.count("*").alias("n"))
    shown = _first(files, ["folder"], ["path"], FOLDER_FILES).groupBy("folder").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "path"))), lambda x: name_of(x["path"])), ", ").alias("names"))
    both = folders.join(counts, "folder", "left").join(shown, "folder", "left")
    text = F.when(F.col("n").isNull(), "only subdirectories").when(F.col("n") > FOLDER_FILES, F.concat("names", F.lit(", … ("), F.col("n").cast("string"), F.lit(" in all)"))).otherwise(F.col("names"))
    return both.select("folder", F.concat(F.lit("- "), "folder", F.lit("/: "), text).alias("line"))


def _tests(files: DataFrame, index: CodeMap) -> DataFrame:
    """(file, line): tests that import a file or are named after it."""
    pairs = tools.tests_by_name(index).select("test", "source").union(tools.tests_by_import(index).select("test", "source")).distinct()
    mine = pairs.join(files.select(F.col("file").alias("source")), "source", "left_semi").where("test <> source")
    shown = _first(mine, ["source"], ["test"], TESTS).groupBy("source").agg(F.array_join(F.array_sort(F.collect_list("test")), ", ").alias("tests"))
    return shown.select(F.col("source").alias("file"), F.concat("tests", F.lit(" (for "), "source", F.lit(")")).alias("line"))


def _stack(prompts: DataFrame, id_col: str, text_col: str, versions: DataFrame) -> DataFrame:
    """(id, line) of the frameworks and tools (name, version) that a prompt's words name, wholly or by their last part."""
    words = prompts.select(F.col(id_col).alias("id"), F.explode(F.array_distinct(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"[^\w@/.+-]+"))).alias("word"))
    words = words.select("id", F.regexp_replace("word", r"[.]+$", "").alias("word")).where("word <> ''")
    known = versions.select("name", "version").distinct().withColumn("word", F.explode(F.array_distinct(F.array(F.lower("name"), F.element_at(F.split(F.lower("name"), "/"), -1)))))
    shown = F.when(F.coalesce("version", F.lit("")) == "", F.col("name")).otherwise(F.concat_ws(" ", "name", "version"))
    return words.join(known, "word").groupBy("id").agg(F.concat(F.lit("Stack versions in use: "), F.array_join(F.array_sort(F.collect_set(shown)), ", ")).alias("line"))


def lines_of(prompts: DataFrame, index: CodeMap, id_col: str, text_col: str, versions: DataFrame | None = None) -> DataFrame:
    """(id, section, at, row, line): what a pack may hold, in order of section, the name's place and row."""
    # each is read by several of the sections
    names = settled(named(prompts, id_col, text_col), "names")
    places = settled(paths_of(names, index), "places")
    symbols = settled(symbols_of(names.where("kind = 'symbol'"), index), "symbols")
    paths = names.join(places, "path")
    # a path is looked up first; a symbol only where it is no symbol
    known = names.where("kind = 'symbol'").join(symbols.select("name").distinct(), "name", "left_semi").select("id", "at")
    by_symbol = names.where("kind = 'symbol'").join(symbols, "name").select("id", "at", "name", F.col("place").alias("row"), symbols["path"].alias("file"), "start_line", "end_line", symbols["kind"].alias("what"), "shown", "doc", "is_test")
    by_path = paths.where("kind = 'path'").unionByName(paths.where("kind = 'symbol'").join(known, ["id", "at"], "left_anti"))
    hit = F.concat(F.lit("- `"), "name", F.lit("`: "), "file", F.lit(":"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"), F.lit("  "), _label(F.col("what")), F.lit(" "), "shown")
    out = by_symbol.select("id", F.lit(0).alias("section"), "at", "row", _with_doc(hit, F.col("doc")).alias("line"))
    named_files = by_path.where("file is not null").select("id", "at", "file")
    out = out.union(named_files.join(_outlines(named_files.select("file").distinct(), index), "file").select("id", F.lit(1), "at", "row", "line"))
    out = out.union(by_path.where("ending is not null").select("id", F.lit(1), "at", F.lit(0), F.concat(F.lit("- `"), "name", F.lit("` matches: "), "ending")))
    named_folders = by_path.where("folder is not null").select("id", "at", "folder")
    out = out.union(named_folders.join(_folders(named_folders.select("folder").distinct(), index), "folder").select("id", F.lit(1), "at", F.lit(0), "line"))
    # tests of the files so far: the first few of them, symbols' files before the others
    ends = by_path.where("ending is not null").select("id", (F.col("at") + 1000).alias("at"), F.posexplode(F.split("ending", ", ")).alias("row", "file"))
    touched = by_symbol.where("not is_test").select("id", "at", "row", "file").union(named_files.select("id", F.col("at") + 1000, F.lit(0), "file")).union(ends.select("id", "at", "row", "file"))
    touched = touched.groupBy("id", "file").agg(F.min(F.struct("at", "row")).alias("first"))
    touched = settled(_first(touched, ["id"], ["first", "file"], TESTED_FILES).select("id", "file", F.col("place").alias("nth")), "touched")
    tested = _first(touched.join(_tests(touched.select("file").distinct(), index), "file"), ["id"], ["nth"], TESTS)
    out = out.union(tested.groupBy("id").agg(F.concat(F.lit("Tests: "), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "line"))), lambda x: x["line"]), "; ")).alias("line")).select("id", F.lit(2), F.lit(0), F.lit(0), "line"))
    if versions is not None:
        out = out.union(_stack(prompts, id_col, text_col, versions).select("id", F.lit(3), F.lit(0), F.lit(0), "line"))
    unknown = names.where("kind = 'symbol'").join(known, ["id", "at"], "left_anti").join(by_path.select("id", "at"), ["id", "at"], "left_anti").where(F.length("needle") >= LEAST_NAME)
    close = tools.blocked_names(index.symbols.select("name"), unknown.select("needle").distinct(), ALIKE, 1).select("needle", F.col("name").alias("meant"))
    hints = _first(unknown.join(close, "needle").where("needle <> meant"), ["id"], ["at"], SUGGESTIONS)
    hint = F.concat(F.lit("`"), "name", F.lit("` (did you mean "), "meant", F.lit("?)"))
    return out.union(hints.groupBy("id").agg(F.concat(F.lit("Not in the code map: "), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", hint.alias("hint")))), lambda x: x["hint"]), "; ")).alias("line")).select("id", F.lit(4), F.lit(0), F.lit(0), "line"))


def context_packs(prompts: DataFrame, index: CodeMap, budget: int, id_col: str = "id", text_col: str = "text", versions: DataFrame | None = None) -> DataFrame:
    """One row a prompt that names something of the map: id, pack (its lines, with a header), tokens, left_out.

    `versions` (name, version) are the stack's dependencies. A line that doesn't fit what is
    left of the budget is left out and counted. Prompts without a known name, null ones among
    them, give no row; prompts with the same id are one; an empty table gives none.
    """
    texts = settled(prompts.groupBy(F.col(id_col).alias("id")).agg(F.array_sort(F.collect_set(text_col)).alias("texts")), "texts")
    asked = settled(texts.select("texts").distinct().withColumn("key", F.monotonically_increasing_id()), "asked")
    packs = _packs(asked.select(F.col("key").alias("id"), F.explode("texts").alias("text")), index, budget, versions)
    return texts.join(packs.withColumnRenamed("id", "key").join(asked, "key"), "texts").select("id", "pack", "tokens", "left_out")


def _packs(prompts: DataFrame, index: CodeMap, budget: int, versions: DataFrame | None) -> DataFrame:
    """(id, pack, tokens, left_out) of prompts (id, text)."""
    rows = settled(lines_of(prompts, index, "id", "text", versions).distinct(), "lines")
    listed = rows.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("section", "at", "row", "line"))).alias("all"))
    cost = lambda line: (estimate_tokens(line) + 1).cast("long")
    start = F.struct(F.array(F.lit(HEADER)).alias("lines"), F.lit(budget).cast("long").alias("left"), F.lit(0).cast("long").alias("out"))
    start = F.struct(start["lines"].alias("lines"), (start["left"] - estimate_tokens(F.lit(HEADER)).cast("long")).alias("left"), start["out"].alias("out"))
    fill = F.aggregate(
        "all", start,
        lambda s, x: F.struct(
            F.when(cost(x["line"]) <= s["left"], F.concat(s["lines"], F.array(x["line"]))).otherwise(s["lines"]).alias("lines"),
            F.when(cost(x["line"]) <= s["left"], s["left"] - cost(x["line"])).otherwise(s["left"]).alias("left"),
            F.when(cost(x["line"]) <= s["left"], s["out"]).otherwise(s["out"] + 1).alias("out"),
        ),
    )
    return listed.withColumn("f", fill).select("id", F.array_join("f.lines", "\n").alias("pack"), (F.lit(budget) - F.col("f.left")).cast("long").alias("tokens"), F.col("f.out").alias("left_out"))
