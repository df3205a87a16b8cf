"""The audit against a count document by document."""

import itertools
import random
import re

import duckdb
import numpy as np
import pytest

from graphloom.llm import filter_audit
from graphloom.llm.queries import ORACLES, op13_filter_audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(docs, labels):
    """The report of (doc_id, text, lang) and (doc_id, quality, toxic), order by order, document by document."""
    rows = []
    for doc, text, lang in docs:
        text = text or ""
        words = WORD.findall(text)
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
            "D": bool(re.search("[#$%&*|]", text)), "E": doc is not None and any(i is not None and i < doc and (t or "") == text for i, t, _ in docs),
        }
        own = [x for x in labels if doc is not None and x[0] == doc]
        rows.append((lang or "", {f for f in fails if fails[f]}, any(x[1] == 1 for x in own), any(x[2] == 1 for x in own)))
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r[1:] for r in rows if r[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order):
                gone = [r for r in left if f in r[0]]
                left = [r for r in left if f not in r[0]]
                shapley[f] += len(gone)
                unique = sum(r[0] == {f} for r in mine)
                out[part, "".join(order), step + 1] = [len(left), len(gone), sum(f in r[0] for r in mine) - len(gone), unique, sum(r[1] for r in gone), sum(r[2] for r in gone), f]
        for key, row in out.items():
            if key[0] == part:
                row[-1] = shapley[row[-1]]
    return {k: tuple(v) for k, v in out.items()}


def keyed(rows):
    return {tuple(r)[:3]: tuple(r)[3:] for r in rows}


@pytest.fixture(scope="module")
def odd():
    r = random.Random(4)
    words = lambda n, k: " ".join(f"w{r.randint(0, k)}" for _ in range(n))
    texts = [None, "", " ", "A B C", "a#b", words(250, 10), words(250, 10_000), words(250, 10_000) + " %", "X" * 30 + words(200, 5000), "é\x85ü\x1cx " * 120, words(199, 9999), words(200, 9999)]
    docs = [(r.choice([None, *range(60)]), r.choice(texts), r.choice([None, "", "en", "de", "en"])) for _ in range(150)]
    labels = [(r.choice([None, *range(60)]), r.choice([None, 0, 1]), r.choice([None, 0, 1])) for _ in range(60)]
    return docs, labels


@pytest.mark.parametrize("chunk", [1 << 20, 7])
def test_against_single_documents(spark, odd, monkeypatch, chunk):
    docs, labels = odd
    monkeypatch.setattr(filter_audit, "CHUNK", chunk)
    d = spark.createDataFrame([(*x, "p", 3) for x in docs], "doc_id long, text string, lang string, part string, bits int").repartition(3)
    found = filter_audit.audit(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert keyed(found) == plain(docs, labels)


def test_bitsets_at_every_border():
    r = np.random.default_rng(2)
    for n in (1, 7, 8, 9, 64, 130):
        parts = np.sort(r.integers(0, 5, n))
        bits = r.integers(0, 128, n)
        for part, before, f, alive, removed, good, toxic in filter_audit.counted(parts, bits):
            left = (parts == part) & (bits & before == 0)
            gone = left & (bits >> f & 1 == 1)
            assert (alive, removed, good, toxic) == tuple(int(x.sum()) for x in (left, gone, gone & (bits & 32 > 0), gone & (bits & 64 > 0)))


def test_whole_table_equals_sql(spark):
    data = "/root/testdata/sf0.001"
    c = duckdb.connect()
    for t in ("documents", "labels"):
        c.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    sql = c.sql(ORACLES["op13_filter_audit"])
    found = op13_filter_audit(spark, data)
    assert sorted(map(tuple, found.collect())) == sorted(sql.select(*found.columns).fetchall())


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs, labels).count() == 0
    one = spark.createDataFrame([(1, "a", "en")], "doc_id long, text string, lang string")
    assert filter_audit.audit(one, labels).count() == 600
