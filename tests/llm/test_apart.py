"""Crowds of texts that are alike and yet apart make no rows of all their pairs."""

import numpy as np
from test_crowds import brute

from graphloom.llm import minhash_dedup


def test_pairs_of_a_crowd_that_stays_apart_are_no_rows(spark, monkeypatch):
    r = np.random.default_rng(11)
    n, base, texts = 500, [f"b{i}" for i in range(204)], []
    for i in range(n):
        words = list(base)
        for j, at in enumerate(r.permutation(40)[:5]):
            words[5 * at + 2] = f"v{i}x{j}"
        texts.append((i * 3, " ".join(words)))
    rows, settle = [], minhash_dedup.settle

    def counted(df, name):
        rows.append(((back := settle(df, name)).count(), name))
        return back

    monkeypatch.setattr(minhash_dedup, "settle", counted)
    got = minhash_dedup.near_duplicate_documents(spark.createDataFrame(texts, "doc_id long, text string").repartition(5))
    assert {row["doc_id"]: row["component_id"] for row in got.collect()} == brute(texts)[0]
    assert max(rows) < (n * n // 4, "")


def test_intersections_of_blocks(monkeypatch):
    monkeypatch.setattr(minhash_dedup, "AT_ONCE", 7)
    r = np.random.default_rng(4)
    sets = [np.unique(r.integers(0, 60, int(n)).astype(np.uint64)) for n in r.integers(1, 40, 30)]
    a, b = np.arange(0, 18), np.arange(9, 30)
    want = [[len(np.intersect1d(sets[x], sets[y])) for y in b] for x in a]
    assert minhash_dedup.shared_sizes(sets, a, b).tolist() == want
