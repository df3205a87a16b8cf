"""Build files as a table of facts, and the versions that they inherit from one another.

Every JSON, TOML, XML, YAML or lock file becomes rows (path, at, place, value) in a task: `at`
names the keys from the root down, `place` numbers the entries of lists along the way. All
rules work on that table: parents of a Maven module are followed to a fixed point by doubling,
catalogs, workspaces and locks are found in the nearest folder above by joins on exploded
ancestors, so no file meets another one that it doesn't name.
"""

from __future__ import annotations

import json
import re
import tomllib
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import directory, name_of

FACTS = "path string, at string, place string, value string"
#: Levels of parents that a build file inherits from, and rounds in which properties are put into one another.
LEVELS, ROUNDS = 8, 6

# Names of the frameworks that a profile lists, by tool.
FRAMEWORKS = {
    "node": ("@angular/core", "@nestjs/core", "@prisma/client", "@remix-run/react", "@sveltejs/kit", "astro", "electron", "expo", "express", "fastify", "graphql", "hono", "koa", "next", "nuxt", "preact", "prisma", "react", "react-native", "redux", "rxjs", "svelte", "tailwindcss", "three", "typeorm", "vue", "zod", "zustand"),
    "rust": ("actix-web", "anyhow", "async-std", "axum", "bevy", "clap", "diesel", "hyper", "rayon", "reqwest", "rocket", "sea-orm", "serde", "sqlx", "tauri", "thiserror", "tokio", "tonic", "tracing", "warp", "wasm-bindgen"),
    "go": ("entgo.io/ent", "github.com/gin-gonic/gin", "github.com/go-chi/chi", "github.com/gofiber/fiber", "github.com/gorilla/mux", "github.com/labstack/echo", "github.com/spf13/cobra", "github.com/stretchr/testify", "go.uber.org/zap", "google.golang.org/grpc", "gorm.io/gorm", "k8s.io/client-go"),
    "python": ("aiohttp", "celery", "django", "fastapi", "flask", "numpy", "pandas", "pydantic", "pyspark", "requests", "scikit-learn", "sqlalchemy", "torch"),
}


def _flat(value: Any, at: str, place: str) -> Iterator[tuple[str, str, str]]:
    if isinstance(value, dict):
        for key, inner in value.items():
            yield from _flat(inner, f"{at}\x1f{key}" if at else str(key), place)
    elif isinstance(value, list):
        for i, inner in enumerate(value):
            yield from _flat(inner, at, f"{place}.{i:06}")
    elif value is not None:
        yield at, place, ("true" if value else "false") if isinstance(value, bool) else str(value)


def _element(node: ET.Element, at: str, place: str) -> Iterator[tuple[str, str, str]]:
    """An element's text, then its children's; children are numbered."""
    if not len(node):
        yield at, place, (node.text or "").strip()
    for i, child in enumerate(node):
        tag = str(child.tag).rpartition("}")[2]
        yield from _element(child, f"{at}\x1f{tag}" if at else tag, f"{place}.{i:06}")


def _xml(text: str) -> Iterator[tuple[str, str, str]]:
    return _element(ET.fromstring(text), "", "")


def _yaml(text: str) -> Any:
    import yaml

    return yaml.safe_load(text)


def _lists(text: str) -> Iterator[tuple[str, str, str]]:
    """Requirements, one a line."""
    for i, line in enumerate(text.splitlines()):
        if line.strip() and not line.lstrip().startswith(("#", "-")):
            yield "requirement", f".{i:06}", line.strip()


def _go(text: str) -> Iterator[tuple[str, str, str]]:
    """`module`, `go` and direct requirements."""
    block = ""
    for i, line in enumerate(text.splitlines()):
        words = line.split("//")[0].split()
        if words[-1:] == ["("]:
            block = words[0]
        elif words == [")"]:
            block = ""
        elif words:
            verb, *rest = [block, *words] if block else words
            if verb in ("module", "go", "toolchain"):
                yield verb, "", rest[0]
            elif verb == "require" and len(rest) > 1 and "// indirect" not in line:
                yield f"require\x1f{rest[0]}", f".{i:06}", rest[1]


_GRADLE = re.compile(r"""\b\w*(?:[iI]mplementation|[aA]pi|[oO]nly|[pP]latform|ksp|kapt)\s*\(?\s*(?:platform\s*\(\s*)?(?:(["'])(?P<plain>[^"'\s]+)\1|libs\.(?P<alias>[\w.]+))""")


def _gradle(text: str) -> Iterator[tuple[str, str, str]]:
    """Coordinates and catalog names that dependencies are given as."""
    for i, found in enumerate(_GRADLE.finditer(text)):
        kind = "alias" if found["alias"] else "plain"
        yield kind, f".{i:06}", found[kind].removesuffix(".get")


#: Reader by the end of a file's name; the first that fits.
READERS = (
    ("pom.xml", _xml), ("go.mod", _go), ("requirements.txt", _lists), ("build.gradle", _gradle), ("build.gradle.kts", _gradle),
    (".toml", lambda t: _flat(tomllib.loads(t), "", "")), ("Cargo.lock", lambda t: _flat(tomllib.loads(t), "", "")), ("poetry.lock", lambda t: _flat(tomllib.loads(t), "", "")), ("uv.lock", lambda t: _flat(tomllib.loads(t), "", "")),
    (".json", lambda t: _flat(json.loads(t), "", "")), (".yaml", lambda t: _flat(_yaml(t), "", "")), (".yml", lambda t: _flat(_yaml(t), "", "")),
)
#: Files that are read at all.
NAMES = ("pom.xml", "go.mod", "requirements.txt", "build.gradle", "build.gradle.kts", "libs.versions.toml", "Cargo.toml", "Cargo.lock", "pyproject.toml", "poetry.lock", "uv.lock", "package.json", "package-lock.json", "pnpm-lock.yaml")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for path, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist(), strict=True):
            read = next(r for end, r in READERS if path.endswith(end))
            try:
                rows += [(path, *fact) for fact in read(text or "")]
            except Exception:  # noqa: BLE001 - a file that its own tool can't read says nothing
                rows.append((path, "unreadable", "", "true"))
        columns = list(zip(*rows, strict=True)) if rows else [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["path", "at", "place", "value"])


def facts(files: DataFrame) -> DataFrame:
    """(path, at, place, value) of the build files among (path, text). One that can't be parsed is the fact `unreadable`; null texts say nothing."""
    return files.where(name_of(F.col("path")).isin(*NAMES) & F.col("text").isNotNull()).select("path", "text").mapInArrow(_read, FACTS)


def _keys(*names: str) -> str:
    return "\x1f".join(names)


def _entry(place: Column) -> Column:
    """The list entry that a fact lies in: its place without the last number."""
    return F.regexp_replace(place, r"\.\d+$", "")


def closure(links: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(path, above, depth) of everything that links (path, above) lead to within `levels` steps, at its least depth, by doubling.

    A cycle ends where it comes back to its start. Every round joins on whole keys and at least
    doubles the depth, so there are as many rounds as the levels have binary digits.
    """
    now = links.select("path", "above").where("path <> above").distinct().withColumn("depth", F.lit(1))
    reach = 1
    while reach < levels:
        far = now.alias("a").join(now.alias("b"), F.col("a.above") == F.col("b.path")).select("a.path", "b.above", (F.col("a.depth") + F.col("b.depth")).alias("depth"))
        now = now.union(far.where(f"path <> above and depth <= {levels}")).groupBy("path", "above").agg(F.min("depth").alias("depth"))
        reach *= 2
    return now


def filled(value: Column, properties: Column, rounds: int = ROUNDS) -> Column:
    """A value with each ${name} replaced by its property, and these in turn; unknown ones are blank."""
    for _ in range(rounds):
        names = F.regexp_extract_all(value, F.lit(r"\$\{([^}]+)\}"), F.lit(1))
        value = F.aggregate(names, value, lambda out, n: F.replace(out, F.concat(F.lit("${"), n, F.lit("}")), F.coalesce(F.try_element_at(properties, n), F.lit(""))))
    return value


def maven(all_facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Packages and dependencies of pom.xml files.

    A module takes properties and managed versions from its parents in the tree, nearest first;
    a parent is named by group and artifact. Its own group and version may be its parent's.
    """
    own = all_facts.where(name_of(F.col("path")) == "pom.xml")
    tag = lambda *names: F.max(F.when((F.col("at") == _keys(*names)) & (F.col("value") != ""), F.col("value")))
    property_ = F.when(F.startswith("at", F.lit(_keys("properties", ""))), F.struct(F.substring("at", len("properties") + 2, 1 << 20).alias("k"), F.col("place"), F.col("value").alias("v")))
    # of a property given twice the last counts
    listed = F.array_sort(F.collect_list(property_))
    named = F.aggregate(listed, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")), lambda out, p: over(F.create_map(p["k"], p["v"]), out))
    poms = own.groupBy("path").agg(
        tag("parent", "groupId").alias("parent_group"), tag("parent", "artifactId").alias("parent_artifact"), tag("parent", "version").alias("parent_version"),
        tag("groupId").alias("g"), tag("artifactId").alias("artifact"), tag("version").alias("v"), named.alias("named"),
    )
    poms = poms.withColumn("group", F.coalesce("g", "parent_group")).withColumn("version", F.coalesce("v", "parent_version"))
    fixed = F.filter(
        F.array(*[F.struct(F.lit(k).alias("k"), F.col(c).alias("v")) for k, c in (("project.groupId", "group"), ("project.artifactId", "artifact"), ("project.version", "version"), ("project.parent.version", "parent_version"))]), lambda p: p["v"].isNotNull()
    )
    poms = poms.withColumn("named", over(F.map_from_entries(fixed), F.col("named")))
    # of two files with the same coordinates the first by path is the parent
    by_name = poms.where("group is not null and artifact is not null").groupBy("group", "artifact").agg(F.min("path").alias("above"))
    links = poms.select("path", F.col("parent_group").alias("group"), F.col("parent_artifact").alias("artifact")).join(by_name, ["group", "artifact"]).select("path", "above")
    chain = closure(links).union(poms.select("path", F.col("path").alias("above"), F.lit(0).alias("depth")))
    seen = chain.join(poms.select(F.col("path").alias("above"), "named"), "above").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("depth", F.map_entries("named").alias("named")))).alias("levels"))
    properties = seen.select("path", F.aggregate("levels", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")), lambda out, x: over(out, F.map_from_entries(x["named"]))).alias("props"))

    def coordinates(*names: str) -> DataFrame:
        """(path, name, raw version) of the dependencies listed there; names are filled from the file's own properties."""
        part = lambda t: F.max(F.when(F.col("at") == _keys(*names, "dependency", t), F.col("value")))
        found = own.where(F.col("at").isin(*[_keys(*names, "dependency", t) for t in ("groupId", "artifactId", "version")])).groupBy("path", _entry(F.col("place")).alias("entry")).agg(part("groupId").alias("dg"), part("artifactId").alias("da"), part("version").alias("raw"))
        found = found.join(poms.select("path", "named"), "path").withColumn("name", F.concat_ws(":", filled(F.coalesce("dg", F.lit("")), F.col("named")), filled(F.coalesce("da", F.lit("")), F.col("named"))))
        return found.groupBy("path", "name").agg(F.max_by(F.coalesce("raw", F.lit("")), "entry").alias("raw"))

    managed = chain.join(coordinates("dependencyManagement", "dependencies").withColumnRenamed("path", "above"), "above").groupBy("path", "name").agg(F.min_by(F.struct("raw", "depth"), "depth").alias("m"))
    rows = coordinates("dependencies").join(managed, ["path", "name"], "left").join(properties, "path")
    mine, theirs = filled(F.col("raw"), F.col("props")), F.coalesce(filled(F.col("m.raw"), F.col("props")), F.lit(""))
    source = F.when(mine != "", F.when(F.contains("raw", F.lit("${")), "property").otherwise("declared")).when(theirs != "", F.when(F.col("m.depth") == 0, "managed").otherwise("inherited")).otherwise("none")
    dependencies = rows.select("path", F.lit("maven").alias("tool"), "name", F.when(mine != "", mine).otherwise(theirs).alias("version"), source.alias("source"))
    packages = poms.join(properties, "path").select("path", F.lit("maven").alias("tool"), filled(F.col("artifact"), F.col("props")).alias("name"), filled(F.col("version"), F.col("props")).alias("version"))
    return packages, dependencies


def over(nearer: Column, farther: Column) -> Column:
    """Two maps as one; what both have is the nearer one's."""
    return F.map_concat(nearer, F.map_filter(farther, lambda k, _: ~F.map_contains_key(nearer, k)))


def _ancestors(folder: Column) -> Column:
    """A folder and all above it, nearest first, with their distance; the root is the empty string."""
    steps = F.when(folder == "", F.array().cast("array<string>")).otherwise(F.split(folder, "/"))
    return F.transform(F.sequence(F.size(steps), F.lit(0), F.lit(-1)), lambda n: F.struct((F.size(steps) - n).alias("far"), F.array_join(F.slice(steps, F.lit(1), n), "/").alias("folder")))


def nearest(paths: DataFrame, files: DataFrame) -> DataFrame:
    """(path, found): for each path the file of `files` (folder, found) in its folder or the nearest above that has one."""
    up = paths.select("path").distinct().select("path", F.explode(_ancestors(directory(F.col("path")))).alias("a")).select("path", "a.folder", "a.far")
    return up.join(files, "folder").groupBy("path").agg(F.min_by("found", F.struct("far", "found")).alias("found"))


def _tables(own: DataFrame, sections: dict[str, int]) -> DataFrame:
    """(path, rank, name, field, value) of the entries of tables of dependencies; a plain value is its version."""
    cases = None
    for section, rank in sections.items():
        hit = F.startswith("at", F.lit(section + "\x1f"))
        value = F.struct(F.lit(rank).alias("rank"), F.split(F.expr(f"substring(at, {len(section) + 2}, 1048576)"), "\x1f").alias("rest"))
        cases = F.when(hit, value) if cases is None else cases.when(hit, value)
    found = own.withColumn("e", cases).where("e is not null")
    return found.select("path", "e.rank", F.element_at("e.rest", 1).alias("name"), F.when(F.size("e.rest") > 1, F.element_at("e.rest", -1)).otherwise("version").alias("field"), "value")


def rust(all_facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Packages and dependencies of Cargo.toml files: a locked version first, then the crate's own, then its workspace's, then the path or repository."""
    own = all_facts.where(name_of(F.col("path")) == "Cargo.toml")
    field = lambda c, n: F.max(F.when(F.col("field") == n, F.col("value"))).alias(c)
    fields = [field("spec", "version"), field("shared", "workspace"), field("local", "path"), field("git", "git")]
    listed = _tables(own, {"dependencies": 1, "dev-dependencies": 2, "build-dependencies": 3}).groupBy("path", "rank", "name").agg(*fields).groupBy("path", "name").agg(F.min_by(F.struct("spec", "shared", "local", "git"), "rank").alias("d")).select("path", "name", "d.*")
    offered = _tables(own, {_keys("workspace", "dependencies"): 1}).groupBy("path", "name").agg(*fields).select(F.col("path").alias("found"), "name", F.col("spec").alias("offered"))
    roots = own.where(F.startswith("at", F.lit(_keys("workspace", "")))).select(directory(F.col("path")).alias("folder"), F.col("path").alias("found")).distinct()
    locks = all_facts.where(name_of(F.col("path")) == "Cargo.lock")
    locked = _locked(locks)
    at_lock = locks.select(directory(F.col("path")).alias("folder"), F.col("path").alias("found")).distinct()
    rows = listed.join(nearest(listed, roots).withColumnRenamed("found", "root"), "path", "left").join(offered.withColumnRenamed("found", "root"), ["root", "name"], "left")
    rows = rows.join(nearest(listed, at_lock).withColumnRenamed("found", "lock"), "path", "left").join(locked, ["lock", "name"], "left")
    inherited = F.when(F.col("shared") == "true", F.col("offered"))
    version = F.coalesce("locked", "spec", inherited, "local", "git", F.lit(""))
    source = F.when(F.col("locked").isNotNull(), "lock").when(F.col("spec").isNotNull(), "declared").when(inherited.isNotNull(), "workspace").when(F.col("local").isNotNull(), "path").when(F.col("git").isNotNull(), "git").otherwise("none")
    packages = own.groupBy("path").agg(F.max(F.when(F.col("at") == _keys("package", "name"), F.col("value"))).alias("name"), F.max(F.when(F.col("at") == _keys("package", "version"), F.col("value"))).alias("version"))
    return packages.select("path", F.lit("rust").alias("tool"), "name", "version"), rows.select("path", F.lit("rust").alias("tool"), "name", version.alias("version"), source.alias("source"))


def _locked(locks: DataFrame) -> DataFrame:
    """(lock, name, locked) of files that list [[package]] tables; of several versions the first listed."""
    part = lambda k: F.max(F.when(F.col("at") == _keys("package", k), F.col("value")))
    found = locks.groupBy("path", "place").agg(part("name").alias("name"), part("version").alias("locked")).where("name is not null and locked is not null")
    return found.groupBy(F.col("path").alias("lock"), F.lower("name").alias("name")).agg(F.min_by("locked", "place").alias("locked"))


def node(all_facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Packages and dependencies of package.json files: the version of the nearest package-lock.json, for the package itself before the hoisted one, then the declared range."""
    own = all_facts.where(name_of(F.col("path")) == "package.json")
    listed = _tables(own, {"dependencies": 1, "devDependencies": 2, "peerDependencies": 3, "optionalDependencies": 4}).groupBy("path", "name").agg(F.min_by("value", "rank").alias("spec"))
    locks = all_facts.where(name_of(F.col("path")) == "package-lock.json")
    at_lock = locks.select(directory(F.col("path")).alias("folder"), F.col("path").alias("found")).distinct()
    key = F.split("at", "\x1f")
    entries = locks.where((F.get(key, F.lit(0)) == "packages") & (F.size(key) == 3) & (F.get(key, F.lit(2)) == "version")).select(F.col("path").alias("lock"), F.get(key, F.lit(1)).alias("key"), "value")
    entries = entries.where(F.contains("key", F.lit("node_modules/"))).select("lock", F.regexp_extract("key", r"^(.*?)/?node_modules/((?:(?!node_modules/).)*)$", 1).alias("owner"), F.regexp_extract("key", r"^(?:.*?)/?node_modules/((?:(?!node_modules/).)*)$", 1).alias("name"), F.col("value").alias("locked")).where("name <> ''")
    rows = listed.join(nearest(listed, at_lock).withColumnRenamed("found", "lock"), "path", "left")
    folder, home = directory(F.col("path")), directory(F.col("lock"))
    inside = F.when(folder == home, F.lit("")).when(home == "", folder).otherwise(F.expr("substring(path, length(lock) - length('package-lock.json') + 1, length(path) - length(lock) + length('package-lock.json') - length('/package.json'))"))
    rows = rows.withColumn("inside", inside)
    mine = entries.withColumnRenamed("owner", "inside").withColumnRenamed("locked", "mine")
    hoisted = entries.where("owner = ''").select("lock", "name", F.col("locked").alias("hoisted"))
    rows = rows.join(mine, ["lock", "inside", "name"], "left").join(hoisted, ["lock", "name"], "left")
    locked = F.coalesce("mine", "hoisted")
    packages = own.groupBy("path").agg(F.max(F.when(F.col("at") == "name", F.col("value"))).alias("name"), F.max(F.when(F.col("at") == "version", F.col("value"))).alias("version"))
    return packages.select("path", F.lit("node").alias("tool"), "name", "version"), rows.select("path", F.lit("node").alias("tool"), "name", F.coalesce(locked, "spec").alias("version"), F.when(locked.isNotNull(), "lock").otherwise("declared").alias("source"))


def go(all_facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Modules and direct requirements of go.mod files; versions are exact there."""
    own = all_facts.where(name_of(F.col("path")) == "go.mod")
    packages = own.groupBy("path").agg(F.max(F.when(F.col("at") == "module", F.col("value"))).alias("name"), F.max(F.when(F.col("at") == "go", F.col("value"))).alias("version"))
    rows = _tables(own, {"require": 1}).groupBy("path", "name").agg(F.max("value").alias("version"))
    return packages.select("path", F.lit("go").alias("tool"), "name", "version"), rows.select("path", F.lit("go").alias("tool"), "name", "version", F.lit("declared").alias("source"))


def gradle(all_facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Build files and their dependencies: coordinates as written, or names of the nearest version catalog above (gradle/libs.versions.toml)."""
    build = all_facts.where(name_of(F.col("path")).isin("build.gradle", "build.gradle.kts"))
    catalog = all_facts.where(F.endswith("path", F.lit("gradle/libs.versions.toml")))
    place = F.regexp_replace(F.regexp_replace(directory(F.col("path")), "(^|/)gradle$", ""), "/$", "")
    at_catalog = catalog.select(place.alias("folder"), F.col("path").alias("found")).distinct()
    key = F.split("at", "\x1f")
    # a version is a plain value, or the strict, required or preferred one of a table
    versions = catalog.where(F.get(key, F.lit(0)) == "versions").groupBy(F.col("path").alias("catalog"), F.get(key, F.lit(1)).alias("ref")).agg(F.min_by("value", F.element_at(key, -1) == "reject").alias("named"))
    field = F.array_join(F.slice(key, 3, 9), ".")
    part = lambda k: F.max(F.when(field == k, F.col("value")))
    accessor = F.regexp_replace(F.get(key, F.lit(1)), "[-_]", ".")
    libraries = catalog.where(F.get(key, F.lit(0)) == "libraries").groupBy(F.col("path").alias("catalog"), accessor.alias("value")).agg(part("").alias("whole"), part("module").alias("module"), part("group").alias("g"), part("name").alias("n"), part("version").alias("v"), part("version.ref").alias("ref"))
    whole = F.split("whole", ":")
    libraries = libraries.join(versions, ["catalog", "ref"], "left").select(
        "catalog", "value", F.coalesce("module", F.when(F.col("g").isNotNull(), F.concat("g", F.lit(":"), "n")), F.array_join(F.slice(whole, 1, 2), ":")).alias("name"), F.coalesce("v", "named", F.get(whole, F.lit(2)), F.lit("")).alias("version")
    )
    used = build.where("at = 'alias'").select("path", "value").distinct()
    by_alias = used.join(nearest(used, at_catalog).withColumnRenamed("found", "catalog"), "path").join(libraries, ["catalog", "value"]).select("path", "name", "version", F.lit("catalog").alias("source"))
    parts = F.split("value", ":")
    plain = build.where("at = 'plain'").select("path", F.array_join(F.slice(parts, 1, 2), ":").alias("name"), F.coalesce(F.get(parts, F.lit(2)), F.lit("")).alias("version")).where(F.contains("name", F.lit(":")))
    rows = by_alias.union(plain.withColumn("source", F.when(F.col("version") == "", "none").otherwise("declared")))
    rows = rows.groupBy("path", "name").agg(F.max_by(F.struct("version", "source"), F.struct(F.col("version") != "", "source")).alias("d")).select("path", F.lit("gradle").alias("tool"), "name", "d.version", "d.source")
    return build.select("path", F.lit("gradle").alias("tool"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("version")).distinct(), rows


def python(all_facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Projects and requirements of pyproject.toml and requirements.txt: the version of the nearest lock, the pinned one, or the specifier."""
    own = all_facts.where(name_of(F.col("path")).isin("pyproject.toml", "requirements.txt"))
    direct = F.col("at").isin("requirement", _keys("project", "dependencies")) | F.startswith("at", F.lit(_keys("project", "optional-dependencies", "")))
    bare = F.trim(F.regexp_extract("value", r"^([^;#]*)", 1))
    spec = own.where(direct).select("path", "place", bare.alias("spec")).where((F.col("spec") != "") & ~F.contains("spec", F.lit("://")))
    name = F.regexp_replace(F.lower(F.regexp_extract("spec", r"^([A-Za-z0-9][A-Za-z0-9._-]*)", 1)), "[-_.]+", "-")
    rest = F.trim(F.regexp_replace("spec", r"^[A-Za-z0-9][A-Za-z0-9._-]*\s*(\[[^\]]*\])?", ""))
    pinned = F.regexp_extract(rest, r"^===?\s*([^\s,]+)$", 1)
    listed = spec.select("path", "place", name.alias("name"), F.when(pinned != "", pinned).otherwise(rest).alias("spec")).where("name <> ''").groupBy("path", "name").agg(F.min_by("spec", "place").alias("spec"))
    poetry = _tables(own, {_keys("tool", "poetry", "dependencies"): 1}).where("field = 'version' and name <> 'python'").groupBy("path", F.regexp_replace(F.lower("name"), "[-_.]+", "-").alias("name")).agg(F.max("value").alias("spec"))
    listed = listed.union(poetry).groupBy("path", "name").agg(F.max("spec").alias("spec"))
    locks = all_facts.where(name_of(F.col("path")).isin("poetry.lock", "uv.lock"))
    at_lock = locks.select(directory(F.col("path")).alias("folder"), F.col("path").alias("found")).distinct()
    rows = listed.join(nearest(listed, at_lock).withColumnRenamed("found", "lock"), "path", "left").join(_locked(locks).withColumn("name", F.regexp_replace("name", "[-_.]+", "-")), ["lock", "name"], "left")
    source = F.when(F.col("locked").isNotNull(), "lock").when(F.col("spec") != "", "declared").otherwise("none")
    first = lambda *ats: F.coalesce(*[F.max(F.when(F.col("at") == a, F.col("value"))) for a in ats])
    packages = own.groupBy("path").agg(first(_keys("project", "name"), _keys("tool", "poetry", "name")).alias("name"), first(_keys("project", "version"), _keys("tool", "poetry", "version")).alias("version"))
    return packages.select("path", F.lit("python").alias("tool"), "name", "version"), rows.select("path", F.lit("python").alias("tool"), "name", F.coalesce("locked", "spec").alias("version"), source.alias("source"))


TOOLS = (maven, gradle, rust, node, go, python)


def dependencies(all_facts: DataFrame) -> DataFrame:
    """(path, tool, name, version, source) of every dependency of every build file; `source` says where the version comes from."""
    out = None
    for tool in TOOLS:
        rows = tool(all_facts)[1]
        out = rows if out is None else out.unionByName(rows)
    return out


def profile(all_facts: DataFrame) -> DataFrame:
    """One row a build file: path, tool, name, version, number of dependencies, and its frameworks with their versions, in order of name."""
    packages = listed = None
    for tool in TOOLS:
        p, d = tool(all_facts)
        packages, listed = (p, d) if packages is None else (packages.unionByName(p), listed.unionByName(d))
    plain = F.when(F.col("tool") == "go", F.regexp_replace("name", r"/v\d+$", "")).otherwise(F.col("name"))
    known = F.lit(False)
    for tool, names in FRAMEWORKS.items():
        known = known | ((F.col("tool") == tool) & plain.isin(*names))
    shown = F.when(F.col("version") == "", F.col("name")).otherwise(F.concat_ws(" ", "name", "version"))
    found = listed.groupBy("path").agg(F.count("*").alias("dependencies"), F.array_join(F.array_sort(F.collect_list(F.when(known, shown))), ", ").alias("frameworks"))
    return packages.join(found, "path", "left").select("path", "tool", "name", "version", F.coalesce("dependencies", F.lit(0)).alias("dependencies"), F.coalesce("frameworks", F.lit("")).alias("frameworks"))
