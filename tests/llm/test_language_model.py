"""The recurrent model: its gradient's use, sums against brute force, few long texts, ends outside the table's head, learners."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import recurrent_lm as lm


def slow_score(net, cls, slot, ids, end):
    """Natural log-likelihood word by word, with plain loops over one document."""
    known, h, prev, total = len(cls), np.zeros((1, lm.STATE), np.float32), end, 0.0
    for y in ids:
        h, _ = net.step(h, np.array([min(prev, known)]))
        a = (h @ net.wc + net.bc)[0].astype(float)
        k = cls[y] if y < known else len(net.bc) - 1
        total += a[k] - math.log(np.exp(a - a.max()).sum()) - a.max()
        if y < known:
            u = (h @ net.ww[k] + net.bw[k])[0].astype(float)
            total += u[slot[y]] - math.log(np.exp(u - u.max()).sum()) - u.max()
        prev = y
    return total


def small(words=50, classes=5):
    counts = np.arange(words, 0, -1).astype(float)
    cls, slot = lm.classes_of(counts, classes)
    return lm.new_network(counts, 3.0, cls, slot, classes), cls, slot


def test_scores_against_brute_force():
    net, cls, slot = small()
    r = np.random.default_rng(0)
    docs = [r.integers(0, 51, n) for n in (1, 2, 33, 64, 100, 1)]
    got = lm.score_documents(net, cls, slot, docs, 0, lanes=4)
    assert got == pytest.approx([slow_score(net, cls, slot, d, 0) for d in docs], rel=1e-4)


def test_probabilities_sum_to_one():
    net, cls, slot = small()
    scores = lm.score_documents(net, cls, slot, [np.array([3, y]) for y in range(51)], 0)
    first = lm.score_documents(net, cls, slot, [np.array([3])], 0)[0]
    assert np.exp(scores - first).sum() == pytest.approx(1.0, rel=1e-4)


def test_training_learns_and_resets_at_ends():
    """A word that always follows another becomes likely; what stood before an end doesn't matter."""
    net, cls, slot = small()
    before = lm.score_documents(net, cls, slot, [np.array([7, 9, 0])], 0)[0]
    texts = ["w7 w9"] * 4000
    words = {lm.END: 0, **{f"w{i}": i for i in range(1, 50)}}
    n = lm.learn(net, iter(texts), words, cls, slot, 0.02, call=2000)
    after = lm.score_documents(net, cls, slot, [np.array([7, 9, 0])], 0)[0]
    assert n == 12_000 and after > before + 3
    assert lm.flat(lm.unflat(net, lm.flat(net))) == pytest.approx(lm.flat(net))


def test_few_long_texts(spark):
    """The end token is rare, and no longer among the most frequent words."""
    r = np.random.default_rng(1)
    df = spark.createDataFrame([(i, " ".join(f"w{x}" for x in r.integers(0, 300, 3000))) for i in range(4)], "doc_id long, text string")
    got = lm.language_model_scores(df, F.lit(True), table_words=200, least_known=50).collect()
    assert len(got) == 4 and all(x["n_tokens"] == x["n_known"] == 3001 and x["score"] > x["base_score"] - 200 for x in got)


def test_learners_are_averaged(spark):
    """Several learners give one network that beats the base on documents that none of them saw."""
    r = np.random.default_rng(2)
    chain = lambda: " ".join(f"w{x % 40}" for x in r.integers(0, 40) + np.arange(60))
    df = spark.createDataFrame([(i, chain()) for i in range(1200)], "doc_id long, text string").repartition(3)
    got = lm.language_model_scores(df, F.col("doc_id") % 5 != 1, learner_words=20_000).where("doc_id % 5 = 1")
    base, score = got.agg(F.sum("base_score"), F.sum("score")).first()
    assert score > 0.95 * base  # both are negative


def test_every_training_document_is_learned_from(spark, monkeypatch):
    """Learners' words add up to all training words, and a pattern that stands in one document of hundreds is learned."""
    r = np.random.default_rng(3)
    rare = " ".join(["left right up down"] * 400)
    rows = [(i, " ".join(f"w{x}" for x in r.integers(0, 60, 40))) for i in range(600)] + [(777, rare)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    learn = F.col("doc_id") % 5 != 1
    seen = []
    monkeypatch.setattr(lm, "trained", lambda net, texts, n, *rest, **kw: seen.append((n, texts.count())) or net)
    plain = lm.language_model_scores(df.union(spark.createDataFrame([(1001, "left right up down " * 30)], df.schema)), learn).where("doc_id = 1001").first()
    monkeypatch.undo()
    assert seen == [(sum(len(t.split()) + 1 for i, t in rows if i % 5 != 1), sum(i % 5 != 1 for i, _ in rows))]
    found = lm.language_model_scores(df.union(spark.createDataFrame([(1001, "left right up down " * 30)], df.schema)), learn).where("doc_id = 1001").first()
    assert found["score"] > 0.8 * plain["score"]


def test_window_gradients():
    """The step that train takes goes down the loss as much as differences of the loss say."""
    net, cls, slot = small(12, 3)
    r = np.random.default_rng(4)
    stream = r.integers(0, 13, (3, 9))
    loss = lambda n: -sum(_stream_loss(n, cls, slot, row) for row in stream)
    base = lm.flat(net).astype(np.float64)
    moved = lm.flat(lm.train(lm.unflat(net, base), stream, cls, slot, 0, window=8, rate=1e-3, state=None)).astype(np.float64) - base
    at = np.argsort(-np.abs(moved))[:200]
    for i in r.choice(at, 12, replace=False):
        up, down = base.copy(), base.copy()
        up[i] += 3e-3
        down[i] -= 3e-3
        slope = loss(lm.unflat(net, up)) - loss(lm.unflat(net, down))
        assert abs(slope) < 2e-4 or np.sign(slope) == -np.sign(moved[i])


def _stream_loss(net, cls, slot, ids):
    """Log-likelihood of a lane's words after its first."""
    known, h, total = len(cls), np.zeros((1, lm.STATE), np.float32), 0.0
    for prev, y in zip(ids[:-1], ids[1:], strict=True):
        h, _ = net.step(h * (prev != 0), np.array([prev]))
        a = (h @ net.wc + net.bc)[0].astype(float)
        k = cls[y] if y < known else len(net.bc) - 1
        total += a[k] - a.max() - math.log(np.exp(a - a.max()).sum())
        if y < known:
            u = (h @ net.ww[k] + net.bw[k])[0].astype(float)
            total += u[slot[y]] - u.max() - math.log(np.exp(u - u.max()).sum())
    return total


def test_most_frequent_words(spark):
    counts = spark.createDataFrame([(f"w{i:04}", 1 + 5000 // (i + 1)) for i in range(3000)] + [(lm.END, 1)], "word string, count long")
    assert lm.most_frequent(counts, 10_000).num_rows == 3001
    some = lm.most_frequent(counts, 300)
    assert 250 <= some.num_rows <= 360 and lm.END in some["word"].to_pylist()
    assert some["word"].to_pylist()[:150] == [f"w{i:04}" for i in range(150)]
    assert lm.most_frequent(counts.limit(0), 10).num_rows == 0


def test_outputs_are_those_of_a_class_s_words(monkeypatch):
    """A class's slots behind its words are neither learned nor scored, and a long document isn't scored a few words at a time."""
    net, cls, slot = small()
    held, seen = set(np.bincount(cls).tolist()) | {len(net.bc)}, []
    logits = lm._logits
    monkeypatch.setattr(lm, "_logits", lambda s, w, b: seen.append(len(b)) or logits(s, w, b))
    ids = np.arange(8_000) % 51
    lm.score_documents(net, cls, slot, [ids], 0)
    assert len(seen) <= 2 * (len(net.bc) + 1) and set(seen) <= held
    seen.clear()
    lm.train(net, ids[:2_000].reshape(4, -1), cls, slot, 0)
    assert seen and set(seen) <= held
