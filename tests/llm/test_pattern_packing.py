"""Patterns packed: ids against the library, every id in one place, counts of sequences against plain best fit."""

import bisect
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from graphloom.llm import pattern_packing as packing
from graphloom.llm.queries import op12_pattern_packing
from graphloom.llm.tokens import vocabulary_path
from graphloom.llm.word_tokens import WordEncoder

DATA = "/root/testdata/sf0.01"
PARTS = ["a", "b", "The", "'s", "'LL", "don't", "é", "é", "́", "ß", "İ", "Σ", "日本", "Ω", "д", "½", "²", "x" * 70, " ", " ", " ", "  ", "\n", "\t", "\x85", "　", ".", "1", "4567", "!?", "<|endoftext|>", "<|startoftext|>", "\x00", "-", "_", "≠"]


@pytest.fixture(scope="module")
def witness():
    return Tokenizer.from_file(vocabulary_path("word_bpe_49k.json"))


def test_ids_equal_the_librarys(witness):
    encoder = WordEncoder(vocabulary_path("word_bpe_49k.json"), remembered=80_000)
    r = random.Random(3)
    texts = [None, "", " ", "a", "A <|endoftext|> b", *("".join(r.choice(PARTS) for _ in range(r.randint(1, 40))) for _ in range(3000))]
    for _ in range(2):
        ids, sizes = encoder.encode_all(pa.array(texts, pa.string()), 1)
        ends = np.cumsum(sizes)
        for text, a, b in zip(texts, (ends - sizes).tolist(), ends.tolist(), strict=True):
            assert ids[a:b].tolist() == witness.encode(text or "", add_special_tokens=False).ids + [1], repr(text)
    assert [len(x) for x in encoder.encode_all(pa.array([], pa.string()), 1)] == [0, 0]


def best_fit(sizes, capacity):
    free, n = [], 0
    for size in sorted(sizes, reverse=True):
        i = bisect.bisect_left(free, size)
        left = free.pop(i) - size if i < len(free) else capacity - size
        n += i > len(free) or left == capacity - size
        bisect.insort(free, left)
    return len(free)


LENGTHS = {
    "short": lambda r: int(min(4096, max(1, r.lognormvariate(5.5, 1)))),
    "any": lambda r: r.randint(1, 4096),
    "long": lambda r: r.randint(1500, 4000),
    "few kinds": lambda r: r.choice([1000, 1500, 2600, 3000]),
    "one kind": lambda r: 1365,
    "tiny": lambda r: r.randint(1, 3),
}


@pytest.mark.parametrize("name", LENGTHS)
@pytest.mark.parametrize("n", [0, 1, 17, 6000])
def test_plans_hold_every_document_and_few_sequences(name, n):
    r = random.Random(7)
    sizes = [LENGTHS[name](r) for _ in range(n)]
    histogram = {}
    for x in sizes:
        histogram[x] = histogram.get(x, 0) + 1
    bins = packing.packed_bins(histogram, 4096)
    got = {}
    for kind, many in bins:
        assert sum(x * m for x, m in kind) <= 4096 and many > 0
        for x, m in kind:
            got[x] = got.get(x, 0) + m * many
    assert got == histogram
    total = sum(m for _, m in bins)
    assert total <= 1.005 * best_fit(sizes, 4096) + 1
    places = set()
    plan = packing.plan_of(bins)
    for x in histogram:
        for k in range(min(histogram[x], 50)):
            _, lo, base, per, at = plan[[i for i, row in enumerate(plan.tolist()) if row[0] == x and row[1] <= k][-1]].tolist()
            places.add((base + (k - lo) // per, at + (k - lo) % per * x))
    assert len(places) == sum(min(m, 50) for m in histogram.values())


def test_patterns_are_fitted_and_used():
    bins = packing.packed_bins({3000: 1000, 1096: 1000}, 4096)
    assert [kind for kind, n in packing.fitted({3000: 1000, 1096: 1000}, 4096)] == [[[1096], [3000]]]
    assert sum(n for _, n in bins) == 1000


def test_least_squares_against_projected_descent():
    r = np.random.default_rng(1)
    columns = np.array([[0, 1, -1], [1, 2, -1], [0, 2, 3], [3, -1, -1], [0, 0, 1]])
    a = np.zeros((4, 5))
    for j, c in enumerate(columns):
        for i in c[c >= 0]:
            a[i, j] += 1
    for _ in range(20):
        b, w = r.uniform(0, 100, 4), r.uniform(0.2, 1, 4)
        x = packing.non_negative_least_squares(columns, b, w)
        y = np.zeros(5)
        for _ in range(20_000):
            y = np.maximum(0, y - 0.05 * a.T @ (w * w * (a @ y - b)))
        assert (x >= 0).all()
        assert np.linalg.norm(w * (a @ x - b)) <= np.linalg.norm(w * (a @ y - b)) + 1e-6


def checked(found, texts, witness, capacity):
    """Every document's ids lie in order in its pieces, sequences have no holes and fit."""
    sequences, pieces = {}, {}
    for r in found:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        pieces.setdefault(r["doc_id"], []).append(tuple(r)[1:5])
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    for doc, text in texts:
        ids = np.array([*witness.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        expected = [(k, a, min(capacity, len(ids) - a), zlib.crc32(ids[a : a + capacity].tobytes())) for k, a in enumerate(range(0, len(ids), capacity))]
        assert sorted(pieces[doc]) == expected
    assert len(found) == sum(map(len, pieces.values()))
    return len(sequences)


def test_whole_table(spark, witness):
    texts = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    found = op12_pattern_packing(spark, DATA).collect()
    n = checked(found, texts, witness, 4096)
    assert n <= best_fit([r["length"] for r in found], 4096) + 2


def test_odd_rows(spark, witness):
    texts = [(1, None), (2, ""), (3, "One two. " * 300), (4, "x " * 64), (5, "x " * 63), (6, "x"), (7, "x"), (8, "x " * 65)]
    df = spark.createDataFrame([(*t, 9, "n") for t in texts], "doc_id long, text string, length int, number string").repartition(4)
    checked(packing.pack_by_patterns(df, capacity=64).collect(), texts, witness, 64)
    assert packing.pack_by_patterns(df.limit(0)).count() == 0
    again = df.where("doc_id = 6").union(df.where("doc_id = 6")).withColumn("doc_id", df.doc_id * None)
    assert [r["doc_id"] for r in packing.pack_by_patterns(again).collect()] == [None, None]


@pytest.mark.parametrize("windows", range(3, 21))
def test_differencing_takes_one_more_window_before_it_cuts(windows):
    """Items of a little more than a third of the capacity: they need half as many windows again, or one more is enough."""
    from graphloom.llm.packing import differencing, windows_of

    r = random.Random(windows)
    for _ in range(40):
        sizes = [r.randint(150, 700) for _ in range(windows * 2)]
        capacity = -(-sum(sizes) // windows)
        fits = [w for w in (windows, windows + 1) if (w * capacity - sum(sizes)) * 4 <= w * capacity and max(sum(sizes[i] for i in x) for x in differencing(sizes, w)) <= capacity]
        found = windows_of(sizes, capacity)
        assert sum(n for w in found for _, _, n in w) == sum(sizes)
        assert max(sum(n for _, _, n in w) for w in found) <= capacity
        pieces = sum(map(len, found))
        assert pieces == len(sizes) if fits else pieces > len(sizes)
        assert len(found) == (fits[0] if fits else len(found))


def test_budgets_pass_over_what_weighs_nothing():
    from graphloom.llm.mixing import leaf_budgets

    got = leaf_budgets([(("a", "x"), 100.0), (("a", "y"), 10.0), (("b", "z"), 100.0)], 100.0, {("a", "x"): 0.0}, 1.0)
    assert got == {("a", "x"): 0.0, ("a", "y"): 10.0, ("b", "z"): pytest.approx(90.0)}
    got = leaf_budgets([(("a", "x"), 100.0), (("b", "z"), 30.0)], 100.0, {("a",): 0.0}, 1.0)
    assert got == {("a", "x"): 0.0, ("b", "z"): pytest.approx(30.0)}
