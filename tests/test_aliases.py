"""Imports by aliases, workspace packages and crates: trees with known targets, and chains of configurations against plain Python."""

import json
import random

from pyspark.sql import functions as F

from graphloom.extraction import aliases
from graphloom.extraction.tables import resolve

NONE = "path string, target string, resolved string"


def resolved(spark, sources, imports):
    """{(path, target): resolved} of imports (path, target) in a tree {path: text or language}."""
    kinds = {".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".rs": "rust"}
    lang = lambda p: next((x for e, x in kinds.items() if p.endswith(e)), None)
    tree = spark.createDataFrame([(p, lang(p), t) for p, t in sources.items()], "path string, lang string, text string")
    files = tree.select("path", F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("dir"), "lang")
    targets = spark.createDataFrame([(p, lang(p), t) for p, t in imports], "path string, lang string, target string")
    relative, crates = aliases.crate_imports(targets, files, tree)
    out = resolve(targets, files, spark.createDataFrame([], "module string, root string"), (aliases.bare_imports(targets, files, tree), relative), crates)
    rows = [(r["path"], r["target"], r["resolved"]) for r in out.collect()]
    assert len(rows) == len(set(imports))
    return {(p, t): r for p, t, r in rows}


def expect(spark, sources, wanted):
    assert resolved(spark, sources, [(p, t) for p, t, _ in wanted]) == {(p, t): r for p, t, r in wanted}


def test_aliases(spark):
    tree = {
        "shop/tsconfig.json": '{ // own\n "extends": ["./conf/strict", "./conf/base.json"],\n "compilerOptions": {"paths": {"~/*": ["src/*"], "~/parts/*": ["src/none/*", "old/*"], "#*.mock": ["mocks/*"], "env": ["src/env.ts"], "bad": 3,},}}',
        "shop/conf/strict.json": '{"extends": "./base.json", "compilerOptions": {"baseUrl": "../strict"}}',
        "shop/conf/base.json": '{"extends": "./strict.json", "compilerOptions": {"baseUrl": ".."}}',
        "shop/inner/jsconfig.json": '{"extends": "../tsconfig.json"}', "shop/inner/x.ts": "", "broken/tsconfig.json": "{ no", "broken/a.ts": "", "broken/b.ts": "",
        "shop/src/a.ts": "", "shop/src/deep/b.tsx": "", "shop/old/c.ts": "", "shop/mocks/net.ts": "", "shop/src/env.ts": "", "shop/lib/index.ts": "", "shop/src/parts/d.ts": "", "else/e.ts": "",
    }
    expect(spark, tree, [
        ("shop/src/a.ts", "~/deep/b", "shop/src/deep/b.tsx"), ("shop/src/a.ts", "~/deep/b.js", "shop/src/deep/b.tsx"), ("shop/src/a.ts", "env", "shop/src/env.ts"), ("shop/src/a.ts", "#net.mock", "shop/mocks/net.ts"),
        ("shop/src/a.ts", "~/parts/c", "shop/old/c.ts"), ("shop/src/a.ts", "~/parts/d", None), ("shop/src/a.ts", "lib", "shop/lib/index.ts"), ("shop/src/a.ts", "bad", None), ("shop/src/a.ts", "~/a", None), ("shop/src/a.ts", "vue", None),
        ("shop/inner/x.ts", "~/a", "shop/src/a.ts"), ("else/e.ts", "~/a", None), ("broken/a.ts", "b", None), ("broken/a.ts", "./b", "broken/b.ts"),
    ])


def test_packages(spark):
    tree = {
        "package.json": '{"name": "all"}', "libs/kit/package.json": '{"by": {"name": "@s/no"}, "name": "@s/kit"}', "libs/kit/src/index.ts": "", "libs/kit/src/button.tsx": "", "libs/kit/theme.js": "",
        "libs/kitchen/package.json": '{"name": "@s/kit/chen"}', "libs/kitchen/index.js": "", "libs/bad/package.json": "{", "app/main.ts": "",
    }
    expect(spark, tree, [
        ("app/main.ts", "@s/kit", "libs/kit/src/index.ts"), ("app/main.ts", "@s/kit/button", "libs/kit/src/button.tsx"), ("app/main.ts", "@s/kit/theme", "libs/kit/theme.js"),
        ("app/main.ts", "@s/kit/chen", "libs/kitchen/index.js"), ("app/main.ts", "@s/kitty", None), ("app/main.ts", "@s/no", None), ("libs/kit/src/button.tsx", "@s/kit/button", None),
    ])


def test_crates(spark):
    tree = {
        "Cargo.toml": '[workspace]\nmembers = ["c/*"]\n', "c/core/Cargo.toml": '[package]\nversion = "1"\nname = "the-core"\n[dependencies]\nname = "x"\n', "c/core/src/lib.rs": "", "c/core/src/net.rs": "", "c/core/src/net/conn.rs": "",
        "c/app/Cargo.toml": '[package]\nname = "app"\n', "c/app/src/main.rs": "", "c/app/src/cli.rs": "", "c/app/tests/it.rs": "",
    }
    expect(spark, tree, [
        ("c/app/tests/it.rs", "the_core::Client", "c/core/src/lib.rs"), ("c/app/src/main.rs", "the_core::net::connect", "c/core/src/net.rs"), ("c/app/src/cli.rs", "crate::Config", "c/app/src/main.rs"), ("c/app/src/cli.rs", "serde::Value", None),
        ("c/core/src/net/conn.rs", "super::shared", "c/core/src/net.rs"), ("c/core/src/net/conn.rs", "super::super::VERSION", "c/core/src/lib.rs"), ("c/core/src/net.rs", "self::conn::open", "c/core/src/net/conn.rs"),
        ("c/core/src/net.rs", "self::own", None), ("c/app/src/main.rs", "some::net::conn::Open", "c/core/src/net/conn.rs"), ("c/core/src/lib.rs", "super::super::super::super::x", None),
    ])


def test_chains_and_cycles(spark):
    random.seed(5)
    parents = {i: random.sample(range(i + 1, i + 4), random.choice([0, 1, 1, 2])) for i in range(24)} | {i: [] for i in range(24, 28)}
    parents |= {40 + i: [40 + (i + 1) % 3] for i in range(3)}
    base = {i: f"b{i}" for i in parents if i % 4 == 3 or i == 42}
    text = lambda i: json.dumps({"extends": [f"./c{p}" for p in parents[i]], "compilerOptions": {"baseUrl": base[i]} if i in base else {}})
    tree = spark.createDataFrame([(f"c{i}.json", text(i)) for i in parents], "path string, text string")

    def first(i, seen=()):
        if i in base:
            return base[i]
        return next((x for p in reversed(parents[i]) if p not in seen for x in [first(p, (*seen, i))] if x), None)

    got = {r["path"]: r["base"] for r in aliases.settings(aliases.configurations(tree)).collect()}
    assert got == {f"c{i}.json": first(i) for i in parents}


def test_empty_and_null(spark):
    tree = spark.createDataFrame([("tsconfig.json", None, None), ("package.json", None, None), ("Cargo.toml", None, None), ("a.ts", "typescript", None)], "path string, lang string, text string")
    files = tree.select("path", F.lit("").alias("dir"), "lang")
    targets = spark.createDataFrame([("a.ts", "typescript", ""), ("a.ts", "typescript", "x"), ("a.rs", "rust", ""), ("a.rs", "rust", "crate"), ("a.rs", "rust", "super")], "path string, lang string, target string")
    assert aliases.bare_imports(targets, files, tree).count() == 0
    assert [x.count() for x in aliases.crate_imports(targets, files, tree)] == [0, 0]
    nothing = tree.where("false")
    assert aliases.bare_imports(targets.where("false"), nothing.select("path", F.lit("").alias("dir"), "lang"), nothing).count() == 0
