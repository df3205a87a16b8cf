"""Extraction, resolution, tools, sources and the store on small trees with known answers."""

import json
import os

from pyspark.sql import functions as F

from graphloom.extraction.source import parse
from graphloom.extraction.tables import CodeMap
from graphloom.functions.text import compact_list
from graphloom.operators import tools, transcripts
from graphloom.sources import files as fs
from graphloom.sources.store import Store, append_rows, write_changed


def names(text, lang):
    return [(s.name, s.kind, s.parent, s.start_line, s.end_line) for s in parse(text, lang).symbols]


def test_broken_python_keeps_what_parses():
    assert [n[0] for n in names("def a():\n    return 1\n\nx = = 2\n\ndef b():\n    pass\n", "python")] == ["a", "b"]
    assert names("", "python") == [] and names("class", "python") == [] and parse("x", None).symbols == []


def test_braces():
    assert names("func (s *S[T]) Do(n int) error {\n\tx := func() {}\n\treturn nil\n}\nconst (\n\tA = 1\n\tB = 2\n)\n", "go") == [("Do", "method", "S", 1, 4), ("A", "constant", None, 6, 6), ("B", "constant", None, 7, 7)]
    assert names("export class A {\n  x = () => 1\n  get y(): number { return 1 }\n}\nfunction f() { function g() {} }\n", "typescript") == [("A", "class", None, 1, 4), ("x", "method", "A", 2, 2), ("y", "method", "A", 3, 3), ("f", "function", None, 5, 5)]
    assert names("pub trait T {\n    fn a(&self);\n}\nimpl T for S {\n    fn a(&self) { \"}\"; }\n}\n", "rust") == [("T", "trait", None, 1, 3), ("a", "method", "T", 2, 2), ("S", "impl", None, 4, 6), ("a", "method", "S", 5, 5)]
    assert parse("// if (x) {\ncall(\"not(this)\")\n", "javascript").refs == [(2, "call")]


TREE = [
    ("src/app/__init__.py", "python", ""), ("src/app/models.py", "python", "class Item:\n    def price(self):\n        return 1\n"), ("src/app/api.py", "python", "from . import models\nfrom .models import Item\nimport app.models\nimport os\n\ndef get():\n    return Item().price()\n"),
    ("tests/app/test_models.py", "python", "from app.models import Item\n\ndef test_price():\n    assert Item().price() == 1\n"), ("other/models.py", "python", "X = 1\n"),
    ("web/a.ts", "typescript", "import {b} from './lib'\nimport {c} from './c.js'\n"), ("web/lib/index.ts", "typescript", "export const b = 1\n"), ("web/c.ts", "typescript", "export const c = 1\n"),
    ("go.mod", None, "module ex.com/m\n"), ("pkg/x/x.go", "go", "package x\n"), ("main.go", "go", "package main\nimport \"ex.com/m/pkg/x\"\n"),
]


def test_map_and_tools(spark):
    c = CodeMap.of(spark.createDataFrame(TREE, "path string, lang string, text string"))
    found = {(r["path"], r["target"]): r["resolved"] for r in c.imports.collect()}
    assert found == {
        ("src/app/api.py", ".models"): "src/app/models.py", ("src/app/api.py", ".models.Item"): "src/app/models.py", ("src/app/api.py", "app.models"): "src/app/models.py", ("src/app/api.py", "os"): None,
        ("tests/app/test_models.py", "app.models.Item"): "src/app/models.py", ("web/a.ts", "./lib"): "web/lib/index.ts", ("web/a.ts", "./c.js"): "web/c.ts", ("main.go", "ex.com/m/pkg/x"): "pkg/x",
    }
    assert [tuple(r) for r in tools.ranked_tests(c, "src/app/models.py").collect()] == [("tests/app/test_models.py", ["name", "imports"])]
    assert [r["path"] for r in tools.importers_of(c, "src/app/models.py").orderBy("path").collect()] == ["src/app/api.py", "tests/app/test_models.py"]
    assert [r["path"] for r in tools.importers_of(c, "os").collect()] == ["src/app/api.py"] and [r["path"] for r in tools.importers_of(c, "pkg/x").collect()] == ["main.go"]
    assert [(r["line"], r["caller"], r["is_test"]) for r in tools.callers_of(c, "Item.price").collect()] == [(7, "get", False), (4, "test_price", True)]
    hit = tools.find_symbol(c, "item.price").first()
    assert (hit["name"], hit["parent"], hit["signature"], hit["more"]) == ("price", "Item", "Item.price(self)", False)
    assert [r["line"] for r in tools.read_symbol(c, "price", context=0).orderBy("line").collect()] == [2, 3]
    assert tools.find_symbol(c, "e", limit=1).first()["more"] and tools.find_symbol(c, "nothing").count() == 0


def test_pages_and_lists():
    lines = [f"line {i} " + "x" * 50 for i in range(20)]
    shown, cursor = [], None
    while True:
        part = tools.page(lines, cursor, 300).split("\n")
        if "call again" not in part[-1]:
            shown += part
            break
        shown += part[:-1]
        cursor = part[-1].split('"')[1]
    assert shown == lines and tools.page(lines, "99", 300) == "No more results." and "not a cursor" in tools.page(lines, "x", 300)
    assert compact_list(["a.b.x", "a.b.y"], ".") == "a.b.{x, y}" and compact_list(["a", "b"], ".") == "a, b" and compact_list([], ".") == ""


def test_close_names_against_brute_force(spark):
    from difflib import get_close_matches

    pool = [f"{a}_{b}" for a in ("retry", "return", "read", "reset") for b in ("call", "cell", "all", "x", "policy")]
    names_ = spark.createDataFrame([(n,) for n in pool], "name string")
    for needle in ("retry_cal", "red_policy", "zzz", "x"):
        got = tools.close_names(names_, spark.createDataFrame([(needle,)], "needle string")).collect()
        assert sorted(r["name"] for r in got) == sorted(get_close_matches(needle, pool, 5, 0.75))


def test_blocked_names_lose_no_pair_at_the_cutoff(spark):
    from difflib import SequenceMatcher

    pool = ["retry_call", "etry_call", "xretry_call", "Part21", "abcdef", "abcdefghi", "zaaaa", "aaaaz", "é_1𝒳", "é_1𝒳x", "", "a" * 60, "b" + "a" * 55, "one_two_three_four", "two_three_four_one", "build_1200000", "guild_1200000"]
    needles = pool + ["abcd", "cdefgh", "tretry_cal", "Prt21", "aaaa", "_1𝒳", "c" + "a" * 58, "uild_120000x", "zzz"]
    like = {(a, b): SequenceMatcher(None, b, a).ratio() for a in needles for b in pool}
    names_, asked = spark.createDataFrame([(x,) for x in [*pool, None]], "name string"), spark.createDataFrame([(x,) for x in [*needles, None]], "needle string")
    for cutoff in (0.8, 0.75):
        got = tools.blocked_names(names_, asked, cutoff, len(pool)).collect()
        assert {(r["needle"], r["name"]): r["ratio"] for r in got} == {k: v for k, v in like.items() if v >= cutoff}
        best = {a: max((v, b) for (x, b), v in like.items() if x == a) for a in needles}
        assert {r["needle"]: (r["ratio"], r["name"]) for r in tools.blocked_names(names_, asked, cutoff).collect()} == {a: v for a, v in best.items() if v[0] >= cutoff}


def test_files_of_a_folder(spark, tmp_path):
    (tmp_path / "_x").mkdir()
    for name, data in {"a.py": b"x = 1\n", "_x/__init__.py": b"", ".hid": b"t", "bin": b"a\0b", "big.txt": b"y" * 3000, "run": b"#!/usr/bin/env python3\n", "skip.log": b""}.items():
        (tmp_path / name).write_bytes(data)
    os.symlink(tmp_path / "a.py", tmp_path / "link.py")
    got = {r["path"]: (r["state"], r["lang"], r["hash"]) for r in fs.scan(spark, str(tmp_path), ["*.log"], most=2000).collect()}
    assert {p: s for p, (s, _, _) in got.items()} == {"a.py": "file", "_x/__init__.py": "file", ".hid": "file", "bin": "skipped", "big.txt": "skipped", "run": "file", "link.py": "skipped"}
    assert got["run"][1] == "python" and len(got["a.py"][2]) == 32


def test_tails(spark, tmp_path):
    log = tmp_path / "log"
    log.write_bytes(b"one\ntwo\nthr")
    assert fs.read_tail(str(log), 0) == (["one", "two"], 8) and fs.read_tail(str(log), 8) == ([], 8)
    log.write_bytes(b"one\ntwo\nthree\n")
    assert fs.read_tail(str(log), 8) == (["three"], 14) and fs.read_tail(str(log), 99) == (["one", "two", "three"], 14) and fs.read_tail(str(log), 0, most=3) == ([], 14)
    rows = fs.tails(spark.createDataFrame([(str(log), 4)], "path string, offset long")).collect()
    assert [r["value"] for r in rows] == ["two", "three", None] and rows[0]["next"] == 14
    log.write_bytes(b'{"type":"assistant","x":1}\n{"type":"user"}\n')
    assert fs.resume_offset(str(log)) == 27
    log.write_bytes(b'{"type":"user"}\n')
    assert fs.resume_offset(str(log)) == 16


def test_store(spark, tmp_path):
    c = CodeMap.of(spark.createDataFrame(TREE[:4], "path string, lang string, text string"))
    rows = lambda c: (c.files.withColumn("mtime_ns", F.lit(1).cast("long")), c.symbols, c.imports, c.refs.withColumn("kind", F.lit("call")))
    store = Store(spark, str(tmp_path / "store"))
    assert store.counts() == {"files": 0, "symbols": 0, "imports": 0, "refs": 0} and store.meta("v") is None
    store.put_files(*rows(c))
    full = store.counts()
    assert full["files"] == 4 and full["symbols"] == 4
    # an increment equals a full build
    edited = [(p, lang, t + "\ndef more():\n    pass\n" if p == "src/app/api.py" else t) for p, lang, t in TREE[:4]]
    whole = CodeMap.of(spark.createDataFrame(edited, "path string, lang string, text string"))
    one = CodeMap(whole.sources.where("path = 'src/app/api.py'"), whole.parsed.where("path = 'src/app/api.py'"))
    store.put_files(rows(one)[0], rows(one)[1], whole.imports.where("path = 'src/app/api.py'"), rows(one)[3])
    same = lambda a, b, *cols: sorted(map(tuple, a.select(*cols).collect())) == sorted(map(tuple, b.select(*cols).collect()))
    assert same(store.table("symbols"), whole.symbols, "path", "id", "name", "start_line") and same(store.table("imports"), whole.imports.where("path in ('src/app/api.py', 'tests/app/test_models.py')"), "path", "target", "resolved")
    store.delete_files(spark.createDataFrame([("src/app/models.py",)], "path string"))
    assert store.counts()["files"] == 3 and not store.table("symbols").where("path = 'src/app/models.py'").count()
    store.touch(spark.createDataFrame([("src/app/api.py", 7, 9)], "path string, size long, mtime_ns long"))
    assert tuple(store.table("files").where("path = 'src/app/api.py'").select("size", "mtime_ns").first()) == (7, 9)
    store.set_resolved(spark.createDataFrame([("src/app/api.py", "os", "found")], "path string, target string, resolved string"))
    assert store.table("imports").where("target = 'os'").first()["resolved"] == "found"
    store.skip(spark.createDataFrame([("bin", 1, 2), ("big", 3, 4)], "path string, size long, mtime_ns long"))
    store.skip(spark.createDataFrame([("bin", 5, 6)], "path string, size long, mtime_ns long"), spark.createDataFrame([("big",)], "path string"))
    assert [tuple(r) for r in store.table("skipped").collect()] == [("bin", 5, 6)]
    store.set_meta({"v": "1"})
    store.set_meta({"v": "2", "w": "x"})
    store.compact()
    assert store.meta("v") == "2" and store.counts()["files"] == 3
    store.clear()
    assert store.counts()["files"] == 0 and store.meta("w") == "x"


def test_appends_and_changed_files(spark, tmp_path):
    rows = spark.createDataFrame([(1, "b")], "z long, a string").coalesce(1)
    for _ in range(2):
        append_rows(rows, str(tmp_path / "log"))
    assert [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "log")).collect()] == [{"a": "b", "z": 1}] * 2
    texts = lambda *x: spark.createDataFrame(list(x), "name string, text string")
    folder = str(tmp_path / "out")
    assert write_changed(texts(("a", "1"), ("b", "2")), folder) == 2 and write_changed(texts(("a", "1"), ("b", "3")), folder) == 1 and write_changed(texts(("b", "3")), folder) == 0
    assert sorted(p for p in os.listdir(folder) if not p.startswith(".")) == ["b"] and open(f"{folder}/b").read() == "3"


def test_active_time_of_a_log(spark):
    line = lambda t, kind, **m: json.dumps({"type": kind, "timestamp": f"2026-01-01T00:00:{t:02d}Z", **m})
    log = [line(0, "assistant", message={}), line(5, "attachment"), line(10, "user", message={"content": "hi"}), line(12, "assistant", message={}), line(40, "queue-operation"), line(20, "user", message={"content": [{"type": "tool_result"}]}), "not json", "[1]"]
    e = transcripts.entries(spark.createDataFrame([("s", i, x) for i, x in enumerate(log)], "session string, ord long, value string"), "own")
    assert e.count() == 6 and transcripts.active_seconds(e).first()["active_s"] == 15.0
