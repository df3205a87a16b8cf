"""Context packs: budgets, order of sections, misspelt names, odd prompts."""

import pytest

from graphloom.extraction.tables import CodeMap
from graphloom.operators import packs
from graphloom.operators.prompts import labels, names, read

FILES = [
    ("src/store.py", "python", '"""Keeps rows. For a while."""\nclass Store:\n    """Holds rows. All of them."""\n    def get(self, k):\n        return k\n\n\nclass Other:\n    def get(self):\n        return 1\n'),
    ("tests/test_store.py", "python", "from src.store import Store\n\n\ndef test_get():\n    assert Store().get(1)\n"),
    ("lib/a/index.ts", "typescript", "export function retryCall(n: number) {\n  return n\n}\n"), ("lib/b/deep/index.ts", "typescript", "export const x = 1\n"), ("docs/notes.md", None, "notes"),
    ("src/many.py", "python", "\n".join(f"def f{i}():\n    return {i}\n" for i in range(20))),
]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    return CodeMap.of(spark.createDataFrame(FILES, "path string, lang string, text string").coalesce(1)).stored(str(tmp_path_factory.mktemp("map")))


@pytest.fixture(scope="module")
def packed(spark, index):
    texts = {1: "Fix `Store.get` in src/store.py with Express", 2: "look at index.ts please", 3: "change `Stoer` and `retryCal()`", 4: None, 5: "", 6: "nothing known here, `Zzzz`", 7: "open src/many.py", 8: "what is in lib", 9: "Rename `Nope.get`", 10: "use .\\src\\store.py"}
    df = spark.createDataFrame(list(texts.items()), "id long, text string").coalesce(1)
    versions = spark.createDataFrame([("express", "4.1"), ("@x/other", None)], "name string, version string")
    return {r["id"]: r for r in packs.context_packs(df, index, 400, versions=versions).collect()}


def test_sections_in_order(packed):
    assert packed[1]["pack"].split("\n") == [
        packs.HEADER, "- `Store.get`: src/store.py:4-5  method Store.get(self, k)", "- src/store.py (python, 4 symbols) — Keeps rows", "  L2 class Store", "    L4 method Store.get(self, k)", "  L8 class Other", "    L9 method Other.get(self)",
        "Tests: tests/test_store.py (for src/store.py)", "Stack versions in use: express 4.1",
    ]


def test_endings_folders_and_parents(packed):
    assert packed[2]["pack"].split("\n")[1:] == ["- `index.ts` matches: lib/a/index.ts, lib/b/deep/index.ts"]
    assert 8 not in packed  # a bare word is no name
    assert [x.split("  ")[0] for x in packed[9]["pack"].split("\n")[1:3]] == ["- `Nope.get`: src/store.py:4-5", "- `Nope.get`: src/store.py:9-10"]
    assert packed[10]["pack"].split("\n")[1].startswith("- src/store.py (python")


def test_long_outlines_are_cut(packed):
    lines = packed[7]["pack"].split("\n")
    assert len(lines) == 2 + packs.OUTLINE_LINES + 1 and lines[-1] == "  … 8 more" and lines[2] == "  L1 fn f0()"


def test_hints_and_silence(packed):
    assert packed[3]["pack"].split("\n")[1:] == ["Not in the code map: `Stoer` (did you mean Store?); `retryCal` (did you mean retryCall?)"]
    assert not {4, 5, 6} & set(packed)


def test_hints_for_names_that_begin_otherwise_or_are_just_alike_enough(spark, index):
    texts = [(1, "change `etryCall`"), (2, "change `Rtore`"), (3, "change `Sttorexx`"), (4, "change `Oher`"), (5, "change `Ohe7`"), (6, "change `ryCallxx`"), (7, "change `est_gt`")]
    got = {r["id"]: r["pack"].split("\n")[1:] for r in packs.context_packs(spark.createDataFrame(texts, "id long, text string"), index, 400).collect()}
    hint = "Not in the code map: `{}` (did you mean {}?)".format
    assert got == {1: [hint("etryCall", "retryCall")], 2: [hint("Rtore", "Store")], 4: [hint("Oher", "Other")], 7: [hint("est_gt", "test_get")]}


def test_budget_is_kept_and_a_shorter_line_still_fits(spark, index):
    df = spark.createDataFrame([(1, "Fix `Store.get` in src/store.py")], "id long, text string").coalesce(1)
    for budget in (20, 60, 95):
        got = packs.context_packs(df, index, budget).collect()[0]
        lines = got["pack"].split("\n")
        assert got["tokens"] == sum((len(x) + 2) // 3 + (i > 0) for i, x in enumerate(lines)) <= max(budget, 16)
        assert len(lines) - 1 + got["left_out"] == 7
    assert packs.context_packs(df.where("false"), index, 50).count() == 0


def test_names_of_prompts():
    assert names("Use `Store.get`, src/a.py; lib\\b.ts or call_me() in HTTPServer, e.g. 3.14/2 and https://x.y/z") == [("Store.get", "symbol"), ("src/a.py", "path"), ("lib\\b.ts", "path"), ("call_me", "symbol"), ("HTTPServer", "symbol")]
    assert names("`two words` `x` OK Plain word A::b x#y `lone") == [("A::b", "symbol"), ("x#y", "symbol")]
    assert len(names(" ".join(f"a_{i}" for i in range(50)))) == 20
    assert labels("Non-goals: speed.\nDone when: it works; size: small goal: twice Goal: once") == {"non_goals": "speed", "acceptance": "it works", "size": "small", "goal": "twice"}
    assert labels("ratio: 3 a:b http://x") == {}
    for text in (None, "", "   ", "`", "::", "()", "a" * 5000, "\x00 `\x00`"):
        assert read(text)["fields"] == {}
