"""Imports by names that a tree itself declares: configured aliases, workspace packages, crates.

What a bare import means follows from its folder, never from the single file, so folders and
targets are made distinct first and a folder that holds a third of all imports is one row a
target from then on. Configurations and packages are found by joins on whole names: folders
above by exploding them, the longest alias by the few lengths that a configuration's aliases
have. Nothing is collected and no table meets another as a whole.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..session import settled
from . import languages as lg
from .prose import relaxed_json
from .tables import directory, join_path, name_of, named_files, normal_path

#: Configurations with aliases, the first of a folder counts; folders of a package that hold its sources; roots of a crate.
CONFIGS = ("tsconfig.json", "jsconfig.json")
SOURCE_FOLDERS = ("src", "")
CRATE_ROOTS = ("lib.rs", "main.rs")
MODULE_ROOTS = ("mod.rs", *CRATE_ROOTS)

_SHAPE = "extends string, compilerOptions struct<baseUrl: string, paths: map<string, string>>"
_BASE_URL, _PACKAGE = 1 << 20, 1 << 21  # candidates of a later kind stand behind all of an earlier one


@F.pandas_udf(StringType())
def _strict(text: pd.Series) -> pd.Series:
    return text.map(relaxed_json, na_action="ignore")


def folders_above(folder: Column) -> Column:
    """(dir, depth) of a folder and of every one above it; the root is '' at depth 0."""
    steps = F.filter(F.split(folder, "/"), lambda x: x != "")
    return F.transform(F.sequence(F.lit(0), F.size(steps)), lambda n: F.struct(F.array_join(F.slice(steps, F.lit(1), n), "/").alias("dir"), n.alias("depth")))


def configurations(sources: DataFrame) -> DataFrame:
    """(path, dir, extends, base_url, paths) of JSON files that may hold aliases.

    `extends` is an array, least important first; `paths` maps a pattern to its replacements. A
    file that can't be read has neither, and a pattern whose value is no list is left out.
    """
    name = name_of(F.col("path"))
    some = sources.where(name.isin(*CONFIGS) | (F.endswith("path", F.lit(".json")) & (F.contains("text", F.lit("compilerOptions")) | F.contains("text", F.lit("extends")))))
    read = some.select("path", directory(F.col("path")).alias("dir"), F.from_json(_strict("text"), _SHAPE).alias("c"))
    extends = F.when(F.startswith("c.extends", F.lit("[")), F.from_json("c.extends", "array<string>")).when(F.col("c.extends").isNotNull(), F.array("c.extends"))
    lists = F.map_filter(F.transform_values("c.compilerOptions.paths", lambda _, v: F.from_json(F.when(F.startswith(v, F.lit("[")), v), "array<string>")), lambda _, v: v.isNotNull())
    return read.select("path", "dir", F.coalesce(extends, F.array().cast("array<string>")).alias("extends"), F.col("c.compilerOptions.baseUrl").alias("base_url"), lists.alias("paths"))


def inherited(configs: DataFrame) -> DataFrame:
    """(path, above, rank): what each configuration takes values from, itself first with the rank [].

    Ranks are the steps taken, the last of several `extends` first, so the least rank among those
    that hold a value names the one that counts. Chains are followed by joining what is reached
    with itself until nothing changes; a way that comes back to a configuration ends there.
    """
    entries = configs.select("path", "dir", F.size("extends").alias("of"), F.posexplode("extends").alias("at", "name")).where(F.rlike("name", F.lit(r"^\.\.?(/|$)")))
    named = normal_path(join_path(F.col("dir"), F.col("name")))
    tried = entries.withColumn("base", named).select("path", (F.col("of") - F.col("at")).alias("step"), F.posexplode(F.array("base", F.concat("base", F.lit(".json")), F.concat("base", F.lit("/tsconfig.json")))).alias("rank", "above"))
    links = tried.join(configs.select(F.col("path").alias("above")), "above").groupBy("path", "step").agg(F.min_by("above", "rank").alias("above"))
    own = configs.select("path", F.col("path").alias("above"), F.array().cast("array<int>").alias("rank"), F.array("path").alias("way"))
    links = settled(links.where("path <> above"), "extends")
    if links.isEmpty():
        return own.select("path", "above", "rank")
    direct = links.select("path", "above", F.array("step").alias("rank"), F.array("path", "above").alias("way"))
    reached = settled(own.unionByName(direct), "configurations")
    state = _state(reached)
    while True:
        a, b = reached.alias("a"), reached.where("path <> above").alias("b")
        further = a.where("path <> above").join(b, F.col("a.above") == F.col("b.path")).where(F.size(F.array_intersect("a.way", "b.way")) == 1)
        further = further.select("a.path", "b.above", F.concat("a.rank", "b.rank").alias("rank"), F.concat("a.way", F.slice("b.way", F.lit(2), F.size("b.way"))).alias("way"))
        best = reached.unionByName(further).groupBy("path", "above").agg(F.min_by(F.struct("rank", "way"), "rank").alias("x")).select("path", "above", "x.rank", "x.way")
        reached = settled(best, "configurations")
        now = _state(reached)
        if now == state:
            return reached.select("path", "above", "rank")
        state = now


def _state(reached: DataFrame) -> tuple:
    return tuple(reached.agg(F.count("*"), F.sum(F.xxhash64("path", "above", "rank").cast("decimal(38,0)"))).first())


def settings(configs: DataFrame) -> DataFrame:
    """(path, base, origin, paths) of each configuration with all that it inherits.

    `base` is where bare names are looked for and null without a base URL; replacements start at
    `origin`: the base, else the folder of the configuration that declares them. Each value is
    taken whole from the nearest that has it, and is relative to that one's folder.
    """
    from_ = configs.select(F.col("path").alias("above"), F.col("dir").alias("home"), "base_url", "paths")
    rows = inherited(configs).join(from_, "above")
    based = F.struct(normal_path(join_path(F.col("home"), F.col("base_url"))).alias("base"))
    best = rows.groupBy("path").agg(F.min_by(based, F.when(F.col("base_url").isNotNull(), F.col("rank"))).alias("b"), F.min_by(F.struct("home", "paths"), F.when(F.col("paths").isNotNull(), F.col("rank"))).alias("p"))
    return best.select("path", "b.base", F.coalesce("b.base", "p.home").alias("origin"), "p.paths")


def alias_bases(wanted: DataFrame, config_settings: DataFrame) -> DataFrame:
    """(config, target) to (config, target, rank, base): where the target may lie, best first.

    Of a configuration's patterns the one that is the target counts, else the one with the most
    characters before its star, then behind it; no other is tried when its replacements fail, but
    the base URL is.
    """
    aliases = config_settings.select(F.col("path").alias("config"), "origin", F.explode("paths").alias("pattern", "ways"))
    starred = F.contains("pattern", F.lit("*"))
    exact = wanted.join(aliases.where(~starred).withColumnRenamed("pattern", "target"), ["config", "target"]).select("config", "target", "origin", "ways", F.lit("").alias("middle"), F.struct(F.lit(1).alias("whole"), F.lit(0).alias("head"), F.lit(0).alias("end")).alias("fit"))
    parted = aliases.where(starred).select("config", "origin", "ways", F.substring_index("pattern", "*", 1).alias("head"), F.expr("substring(pattern, instr(pattern, '*') + 1)").alias("end"))
    lengths = parted.groupBy("config").agg(F.collect_set(F.length("head")).alias("lengths"))
    begun = wanted.join(lengths, "config").withColumn("n", F.explode(F.filter("lengths", lambda n: n <= F.length("target")))).select("config", "target", F.expr("substring(target, 1, n)").alias("head"))
    fits = begun.join(parted, ["config", "head"]).where(F.endswith("target", F.col("end")) & (F.length("target") >= F.length("head") + F.length("end")))
    middle = F.expr("substring(target, length(head) + 1, length(target) - length(head) - length(end))")
    fits = fits.select("config", "target", "origin", "ways", middle.alias("middle"), F.struct(F.lit(0).alias("whole"), F.length("head").alias("head"), F.length("end").alias("end")).alias("fit"))
    best = exact.unionByName(fits).groupBy("config", "target").agg(F.max_by(F.struct("origin", "ways", "middle"), "fit").alias("x")).select("config", "target", "x.*")
    way = F.when(F.contains("way", F.lit("*")), F.concat(F.substring_index("way", "*", 1), "middle", F.expr("substring(way, instr(way, '*') + 1)"))).otherwise(F.col("way"))
    replaced = best.select("config", "target", "origin", "middle", F.posexplode("ways").alias("rank", "way")).select("config", "target", "rank", normal_path(join_path(F.col("origin"), way)).alias("base"))
    below = wanted.join(config_settings.where("base is not null").select(F.col("path").alias("config"), F.col("base").alias("home")), "config")
    return replaced.unionByName(below.select("config", "target", F.lit(_BASE_URL).alias("rank"), normal_path(join_path(F.col("home"), F.col("target"))).alias("base"))).where("base is not null")


def packages(sources: DataFrame) -> DataFrame:
    """(name, root) of the packages that a tree's package.json files name; of two with one name the first by path counts."""
    found = sources.where(name_of(F.col("path")) == "package.json").select(F.get_json_object("text", "$.name").alias("name"), directory(F.col("path")).alias("root"))
    return found.where("name <> ''").groupBy("name").agg(F.min("root").alias("root"))


def crates(sources: DataFrame) -> DataFrame:
    """(name, root) of the crates that a tree's Cargo.toml files name, as code spells them."""
    section = F.get(F.filter(F.split("text", r"(?m)^\s*\["), lambda x: F.rlike(x, F.lit(r"^package\]"))), F.lit(0))
    name = F.replace(F.regexp_extract(section, r"(?m)^\s*name\s*=\s*[\"']([^\"']+)", 1), F.lit("-"), F.lit("_"))
    found = sources.where(name_of(F.col("path")) == "Cargo.toml").select(name.alias("name"), directory(F.col("path")).alias("root"))
    return found.where("name <> ''").distinct()


def _first_files(bases: DataFrame, keys: list[str], files: DataFrame) -> DataFrame:
    """Of the files that bases (keys, lang, rank, base) may name, the first that there is: (keys, file)."""
    parts = [bases.where(F.col("lang") == x.name).select(*keys, "rank", F.posexplode(named_files(F.col("base"), x)).alias("turn", "file")) for x in lg.LANGUAGES if x.strategy == "path" and x.tries]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.join(files.select(F.col("path").alias("file")), "file", "left_semi").groupBy(*keys).agg(F.min_by("file", F.struct("rank", "turn")).alias("file"))


def bare_imports(targets: DataFrame, files: DataFrame, sources: DataFrame) -> DataFrame:
    """(path, target, resolved) of TypeScript and JavaScript imports that start neither at the importer nor at the root.

    Aliases and the base URL of the nearest configuration come first, then the workspace package
    whose name the target is or starts with. Imports that name nothing in the tree give no row.
    """
    web = [x.name for x in lg.LANGUAGES if x.strategy == "path" and x.tries]
    bare = targets.where(F.col("lang").isin(*web) & ~F.rlike("target", F.lit(r"^(\.\.?(/|$)|/)"))).withColumn("dir", directory(F.col("path")))
    asked = bare.select("dir", "lang", "target").distinct()
    configs = settled(configurations(sources), "configurations")
    held = configs.where(name_of(F.col("path")).isin(*CONFIGS)).groupBy(F.col("dir").alias("above")).agg(F.min_by("path", F.array_position(F.array(*map(F.lit, CONFIGS)), name_of(F.col("path")))).alias("config"))
    up = asked.select("dir").distinct().withColumn("u", F.explode(folders_above(F.col("dir")))).select("dir", F.col("u.dir").alias("above"), "u.depth")
    nearest = up.join(held, "above").groupBy("dir").agg(F.max_by("config", "depth").alias("config"))
    placed = asked.join(nearest, "dir")
    bases = alias_bases(placed.select("config", "target").distinct(), settings(configs))
    by_alias = _first_files(placed.select("config", "lang", "target").distinct().join(bases, ["config", "target"]), ["config", "lang", "target"], files)
    by_alias = placed.join(by_alias, ["config", "lang", "target"]).select("dir", "lang", "target", "file", F.lit(0).alias("kind"))

    plain = asked.select("lang", "target").distinct()
    heads = plain.withColumn("u", F.explode(folders_above(F.col("target")))).select("lang", "target", F.col("u.dir").alias("name"), "u.depth")
    owner = heads.join(packages(sources), "name").groupBy("lang", "target").agg(F.max_by(F.struct("name", "root"), "depth").alias("o")).select("lang", "target", "o.*")
    rest = F.regexp_replace(F.expr("substring(target, length(name) + 1)"), "^/+|/+$", "")
    places = F.array(*[join_path(join_path(F.col("root"), F.lit(s)) if s else F.col("root"), rest) for s in SOURCE_FOLDERS])
    by_package = _first_files(owner.select("lang", "target", F.posexplode(places).alias("rank", "base")).withColumn("base", normal_path(F.col("base"))), ["lang", "target"], files)
    by_package = asked.join(by_package, ["lang", "target"]).select("dir", "lang", "target", "file", F.lit(1).alias("kind"))
    found = by_alias.unionByName(by_package).groupBy("dir", "lang", "target").agg(F.min_by("file", "kind").alias("resolved"))
    return bare.join(found, ["dir", "lang", "target"]).select("path", "target", "resolved")


def crate_imports(targets: DataFrame, files: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two tables (path, target, resolved) of Rust imports: those from `self` or `super`, and those of a crate by its name or as `crate`.

    Names behind the crate or module are tried from all of them down to none; then the target is
    an item of that module's own file. A module's folder is the file's without its ending, except
    for those that own the folder they lie in.
    """
    known = files.where("lang = 'rust'").select(F.col("path").alias("file"))
    rust = targets.where("lang = 'rust'").select("path", "target", F.regexp_extract("target", r"^(\w+(?:::\w+)*)(?=::|$)", 1).alias("named")).where("named <> ''")

    def first(rows: DataFrame, roots: tuple[str, ...], beside: bool) -> DataFrame:
        """rows: path, target, anchor and the names behind it."""
        below = F.filter(F.split("rest", "::"), lambda x: x != "")
        heads = rows.select("path", "target", "anchor", below.alias("below")).select("path", "target", "anchor", "below", F.explode(F.sequence(F.size("below"), F.lit(0), F.lit(-1))).alias("n"))
        head = heads.select("path", "target", "n", join_path(F.col("anchor"), F.array_join(F.slice("below", F.lit(1), F.col("n")), "/")).alias("head"), "anchor")
        deeper = F.array(F.concat("head", F.lit(".rs")), F.concat("head", F.lit("/mod.rs")))
        own = F.array(*[F.concat("anchor", F.lit(".rs"))] * beside, *[join_path(F.col("anchor"), F.lit(r)) for r in roots])
        tried = head.select("path", "target", "n", F.posexplode(F.when(F.col("n") > 0, deeper).otherwise(own)).alias("turn", "file")).withColumn("rank", F.struct(-F.col("n"), "turn"))
        return tried.join(known, "file", "left_semi").groupBy("path", "target").agg(F.min_by("file", "rank").alias("resolved"))

    lead = F.substring_index("named", "::", 1)
    base = name_of(F.col("path"))
    at_home = F.when(base.isin(*MODULE_ROOTS), directory(F.col("path"))).otherwise(F.regexp_replace("path", r"\.rs$", ""))
    marks = r"^((?:self|super)(?:::(?:self|super))*)(?:::|$)"
    near = rust.where(lead.isin("self", "super")).select("path", "target", F.split(F.regexp_extract("named", marks, 1), "::").alias("marks"), F.regexp_replace("named", marks, "").alias("rest"))
    ups = F.array_join(F.transform("marks", lambda m: F.when(m == "super", "..").otherwise(".")), "/")
    near = near.select("path", "target", normal_path(join_path(at_home, ups)).alias("anchor"), "rest").where("anchor is not null")
    relative = first(near, MODULE_ROOTS, True)

    declared = crates(sources)
    rest = F.regexp_replace("named", r"^\w+(::)?", "").alias("rest")
    by_name = rust.withColumn("name", lead).join(declared, "name").select("path", "target", "root", rest)
    inside = rust.where(lead == "crate").withColumn("dir", directory(F.col("path")))
    up = inside.select("dir").distinct().withColumn("u", F.explode(folders_above(F.col("dir")))).select("dir", F.col("u.dir").alias("root"), "u.depth")
    home = up.join(declared.select("root").distinct(), "root").groupBy("dir").agg(F.max_by("root", "depth").alias("root"))
    by_home = inside.join(home, "dir").select("path", "target", "root", rest)
    both = by_name.unionByName(by_home).withColumn("anchor", join_path(F.col("root"), F.lit("src")))
    return relative, first(both, CRATE_ROOTS, False)
