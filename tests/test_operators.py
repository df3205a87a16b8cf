"""Known answers of single operators."""

from pyspark.sql import functions as F

from graphloom.extraction.languages import language_of
from graphloom.functions import text as tx
from graphloom.functions import values as va
from graphloom.functions.globs import globs_regex
from graphloom.operators import activity, graph, snapshot


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_repeated_messages_count_once(spark):
    rows = spark.createDataFrame([("m1", 6, 120, "a", 1), ("m1", 6, 400, "b", 2), ("m2", 0, 20, "b", 3), ("m1", -4, None, "b", 4)], "id string, input long, output long, model string, ord long")
    got = {r["id"]: r for r in activity.usage_by_message(rows, ["id"], ["input", "output"], "model", "ord").collect()}
    assert (got["m1"]["input"], got["m1"]["output"], got["m1"]["model"]) == (6, 400, "b")


def test_active_time(spark):
    rows = [("s", 0, 0, True, False, False), ("s", 11, 1, False, False, True), ("s", 60, 2, False, True, False), ("s", 100, 3, True, False, False), ("s", 121, 4, False, False, True)]
    got = activity.active_time(spark.createDataFrame(rows, "session string, at long, ord long, is_prompt boolean, ignored boolean, opens boolean"))
    assert got.first()["active_s"] == 32


def test_decision():
    d = activity.decision
    assert d(-0.25, 0.0, (9, 9), (8, 9)) == "go"
    assert d(-0.15, 0.08, (9, 9), (9, 9)) == "narrow"
    assert d(-0.25, 0.0, (7, 9), (8, 9)) == "narrow"  # fewer passes
    assert d(-0.25, 0.2, (9, 9), (9, 9)) == d(-0.05, 0.0, (9, 9), (9, 9)) == "stop"
    assert d(None, 0.0, (9, 9), (9, 9)) is d(-0.2, None, None, None) is None
    assert d(-0.25, 0.0, None, (9, 9)) == "go"  # missing passes are no drop


def test_bootstrap_against_plain_resampling():
    import random
    import statistics

    assert activity.bootstrap([]) is None
    for values in ([-0.3, -0.2, -0.1, 0.0], [0.5], [-0.4, 0.1, 0.3, -0.2, 0.05]):
        r = random.Random(activity.SEED)
        medians = sorted(statistics.median(r.choices(values, k=len(values))) for _ in range(400))
        assert activity.bootstrap(values, 400) == (medians[9], medians[389])


def test_names_and_paths(spark):
    assert one(spark, tx.last_part(F.lit("a.b::C#run()"))) == "run"
    assert one(spark, tx.leading_parts(F.lit("a.b::C#run()"))) == "a.b.C"
    assert one(spark, tx.leading_parts(F.lit("run"))) is None
    assert one(spark, tx.fold(F.lit("ÉCOLE A"))) == "ÉcolE a".replace("E", "e")
    assert one(spark, tx.remote_url(F.lit("git@github.com:team/repo.git")))["web"] == "https://github.com/team/repo"
    assert language_of("bin/run", "#!/usr/bin/env python3") == "python" and language_of("src/a.ts") == "typescript"
    assert language_of("a/.bashrc") is None and language_of("tool", "#!/usr/bin/node --x") == "javascript" and language_of("x.TS") == "typescript"
    assert one(spark, tx.normalize_signature(F.lit("def  f( a,\n b, ) :"))) == "def f(a, b)"
    assert one(spark, va.tool_name(F.lit("mcp__other__find"), "own")) == "mcp"
    assert [one(spark, va.nonneg(F.parse_json(F.lit(x)))) for x in ("-3", '"3"', "true", "3.5", "3", "null")] == [0, 0, 0, 0, 3, 0]
    assert one(spark, va.duration(F.lit(125.2))) == "2m 05s"


def test_globs(spark):
    """Known answers, by Spark's own expressions."""
    cases = [
        ("build/", ["build/x", "a/build/y/z"], ["builds/x"]), ("src/*.py", ["src/a.py"], ["src/b/a.py", "x/src/a.py"]), ("/top", ["top", "top/x"], ["a/top"]),
        ("**/t_?.py", ["t_1.py", "a/b/t_x.py"], ["t_11.py"]), ("a/**/z", ["a/z", "a/b/c/z"], ["az"]), ("[ab]x", ["ax", "q/bx/y"], ["cx"]), ("[!a]x", ["bx"], ["ax"]),
        ("[[]x", ["[x"], ["x"]), ("[a&&b]x", ["&x", "ax"], ["cx"]), ("[bad", ["[bad"], ["bad"]), ("[]x", ["[]x"], ["x"]), ("[z-a]", ["[z-a]"], ["z"]), ("a.b+c", ["a.b+c"], ["aXb+c"]), ("  *.md ", ["x/y.md"], ["y.mdx"]),
    ]
    for glob, yes, no in cases:
        regex = globs_regex([glob])
        got = {r["p"] for r in spark.createDataFrame([(p,) for p in yes + no], "p string").where(F.rlike("p", F.lit(regex))).collect()}
        assert got == set(yes), glob
    assert not spark.createDataFrame([("",), ("x",)], "p string").where(F.rlike("p", F.lit(globs_regex([" "])))).collect()


def test_closest_and_prefix(spark):
    t = spark.createDataFrame([("tests/a/b/test_x.py", "x")], "path string, key string")
    s = spark.createDataFrame([("src/a/b/x.py", "x"), ("src/c/x.py", "x")], "path string, key string")
    assert [r["source"] for r in graph.closest_sources(t, s).collect()] == ["src/a/b/x.py"]
    found = graph.longest_prefix(spark.createDataFrame([("m/a/b",), ("q",)], "target string"), spark.createDataFrame([("m",), ("m/a",)], "module string"))
    assert [tuple(r) for r in found.collect()] == [("m/a/b", "m/a")]


def test_increments_equal_a_full_build(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "path string, size long")
    new = spark.createDataFrame([("b", 5), ("c", 3), ("d", 4)], "path string, size long")
    diff = {r["path"]: r["state"] for r in snapshot.difference(old, new).collect()}
    assert diff == {"a": "gone", "b": "changed", "d": "new"}
    changed = new.where(F.col("path").isin("b", "d"))
    got = snapshot.upsert(snapshot.delete(old, old.where("path = 'a'")), changed)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, new.collect()))
