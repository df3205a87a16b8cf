"""Crowds of vectors against brute force: dense labels, hot groups, copies, repeated ids, odd column names."""

import numpy as np
import pytest

from graphloom.llm.embedding_dedup import near_duplicate_vectors


def brute(ids, v, labels):
    v = v.astype(float) / np.linalg.norm(v.astype(float), axis=1)[:, None]
    link = (v @ v.T >= 0.98) & np.equal.outer(labels, labels)
    np.fill_diagonal(link, False)
    n = len(ids)
    low = np.asarray(ids, np.int64).copy()
    while True:
        new = np.array([min(low[i], low[link[i]].min(initial=low[i])) for i in range(n)])
        if (new == low).all():
            return link.sum(1), low
        low = new


def check(spark, v, labels, parts=7):
    ids = np.random.default_rng(1).permutation(len(v)) * 3
    df = spark.createDataFrame([(int(i), x.tolist(), int(k), "x", 1) for i, x, k in zip(ids, v, labels, strict=True)], "vec_id long, embedding array<float>, label int, node string, digest int").repartition(parts)
    links, low = brute(ids, v, labels)
    got = {r["vec_id"]: r for r in near_duplicate_vectors(df).collect()}
    return np.array([got[i]["n_links"] for i in ids]), links, np.array([got[i]["component_id"] for i in ids]), low


@pytest.mark.parametrize("mean", [0.935, 0.7, 0.4])
def test_dense_label(spark, mean):
    """Vectors around one centre, with pairs planted above the threshold."""
    r = np.random.default_rng(4)
    n = 3000
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    centre = unit(r.standard_normal(64))
    side = unit(r.standard_normal((n, 64)))
    v = unit(centre * np.sqrt(mean) + side * np.sqrt(1 - mean))
    w = unit(v + 0.9 * np.sqrt(1 - 0.982**2) * unit(r.standard_normal((n, 64))))
    v = np.concatenate([v, w]).astype(np.float32)
    links, want, found, low = check(spark, v, np.ones(len(v), int))
    assert want.sum() >= 1.6 * n and links.sum() >= 0.99 * want.sum() and (found == low).mean() >= 0.99 and (links <= want).all()


def test_hot_group_and_copies(spark):
    r = np.random.default_rng(6)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    far = unit(r.standard_normal((2000, 64)))
    tight = unit(far[0] + 0.17 * unit(r.standard_normal((1500, 64))))
    copies = np.repeat(far[1:2], 700, 0)
    v = np.concatenate([far, tight, copies]).astype(np.float32)
    links, want, found, low = check(spark, v, np.arange(len(v)) % 2)
    assert links.sum() == want.sum() and (found == low).all()


def test_repeated_ids(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [0.0, 2.0], 1), (3, [1.0, 0.0], 1)], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near_duplicate_vectors(df).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (0, 3)}  # id 1 counts by the least of its vectors
