"""What large trees and logs ask of the plans: work dealt over tasks, nothing grouped that needn't meet."""

import ast
import re

from graphloom.extraction.source import _nodes, parse
from graphloom.extraction.tables import CodeMap
from graphloom.operators import packs, tools
from graphloom.plans import code

DATA = "/root/testdata/sf0.001"
GO = [(f"p/a{i}.go", "go", f"package p\n\nfunc F{i}() {{}}\n") for i in range(3)] + [(f"p/a{i}_test.go", "go", "package p\n") for i in (1, 2, 5)]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_keys_are_dealt_before_files_are_parsed(spark):
    assert "RepartitionByExpression [k#" in plan(code.sources(spark, DATA))


def test_every_node_of_a_tree_is_read_once():
    tree = ast.parse("import a\nclass B(c.d()):\n    @e(1)\n    def f(self, g=h()):\n        return [i(j) for k in l() if m()]\n")
    kept = lambda nodes: sorted(ast.dump(n) for n in nodes if not isinstance(n, ast.expr_context))
    assert kept(_nodes(tree)) == kept(ast.walk(tree))


def test_calls_begin_at_whole_words():
    assert set(parse("é9ab(1); a$b<T>(2); x.y (3)\n", "typescript").refs) == {(1, "ab"), (1, "a$b"), (1, "y")}


def test_outlines_take_no_group_a_file(spark):
    c = CodeMap.of(spark.createDataFrame([("a.py", "python", "class A:\n    class B:\n        def c(self):\n            pass\n\ndef d():\n    pass\n"), ("empty.py", "python", "")], "path string, lang string, text string"))
    assert [(r["name"], r["depth"], r["id"]) for r in tools.outline(c, "a.py").collect()] == [("A", 0, 1), ("B", 1, 2), ("c", 2, 3), ("d", 0, 4)]
    assert tools.outline(c).count() == 4 and "FlatMapGroups" not in plan(tools.outline(c))


def test_pairs_of_a_package_are_listed_after_the_others(spark):
    rows = tools.placed_tests(CodeMap.of(spark.createDataFrame(GO, "path string, lang string, text string")))
    got = {(r["source"], r["place"]): (r["test"], r["reasons"]) for r in rows.collect()}
    t = [f"p/a{i}_test.go" for i in (1, 2, 5)]
    own, package = ["is a test file"], ["package"]
    assert got == {
        **{("p/a0.go", n + 1): (x, package) for n, x in enumerate(t)},
        ("p/a1.go", 1): (t[0], ["name", "package"]), ("p/a1.go", 2): (t[1], package), ("p/a1.go", 3): (t[2], package),
        ("p/a2.go", 1): (t[1], ["name", "package"]), ("p/a2.go", 2): (t[0], package), ("p/a2.go", 3): (t[2], package),
        (t[0], 1): (t[0], own), (t[0], 2): (t[1], package), (t[0], 3): (t[2], package),
        (t[1], 1): (t[1], own), (t[1], 2): (t[0], package), (t[1], 3): (t[2], package),
        (t[2], 1): (t[2], own), (t[2], 2): (t[0], package), (t[2], 3): (t[1], package),
    }


def test_prompts_that_ask_the_same_are_answered_once(spark, monkeypatch):
    asked = []
    lines_of = packs.lines_of

    def counted(prompts, *args):
        asked.append(prompts.count())
        return lines_of(prompts, *args)

    monkeypatch.setattr(packs, "lines_of", counted)
    index = CodeMap.of(spark.createDataFrame([("a.py", "python", "def price_of():\n    pass\n")], "path string, lang string, text string"))
    rows = [(i, "Fix `price_of`") for i in range(40)] + [(40, "See a.py"), (40, "Fix `price_of`"), (41, None), (41, "See a.py")]
    got = {r["id"]: r["pack"] for r in packs.context_packs(spark.createDataFrame(rows, "id long, text string"), index, 100).collect()}
    assert asked == [4] and len(got) == 42 and len({got[i] for i in range(40)}) == 1
    assert "price_of" in got[40] and "- a.py (python" in got[40] and got[41].split("\n")[1].startswith("- a.py")


def test_deepest_symbols_take_no_group_a_file(spark):
    df = code.QUERIES["win_tree_indent"](spark, DATA)
    assert "FlatMapGroups" not in plan(df) and {r["deepest"] for r in df.select("deepest").distinct().collect()} == {0, 1}


def test_deepest_symbols_are_found_in_a_file_s_own_row(spark):
    assert "posexplode" not in plan(code.QUERIES["win_tree_indent"](spark, DATA))
    rows = [("a.py", "python", "class A:\n    class B:\n        def c(self):\n            pass\n"), ("a.py", "python", "def d():\n    pass\n"), ("b.go", "go", "package b\n\nfunc F() {}\n"), ("empty.py", "python", ""), ("null.py", "python", None)]
    got = tools.deepest(CodeMap.of(spark.createDataFrame(rows, "path string, lang string, text string"))).collect()
    assert {r["path"]: r["deepest"] for r in got} == {"a.py": 2, "b.go": 0} and len(got) == 2


def test_no_pattern_is_made_of_a_name(monkeypatch):
    def text(i):
        return f"class A{i}:\n    def b{i}(self, x={{'a': 1}}):  # a\n        return c{i}(x)\n\nasync  def किताब{i}(): pass\nLIMIT_{i} = 1\n"

    parse(text(0), "python")
    made = []
    monkeypatch.setattr(re._compiler, "compile", made.append)
    found = parse(text(1), "python")
    assert not made and [(s.name, s.signature) for s in found.symbols] == [("A1", "A1"), ("b1", "b1(self, x={'a': 1})"), ("किताब1", "किताब1()"), ("LIMIT_1", "LIMIT_1 = 1")]
