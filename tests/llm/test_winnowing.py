"""Fingerprints against a plain winnowing of the same hashes, likeness by hand, guarantees, short and unspaced texts."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from graphloom.llm import winnowing

DATA = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (3, "  \n\t "), (4, "one"), (5, "One"), (6, "w x y z " * 9000), (7, "w x y z " * 9000), (8, "a b c d e f"), (8, "a b c d e f"), (9, "é  ü \n x ✓ 漢字かな交じり文は空白を持たない"), (10, "x" * 500), (11, "a b\u00a0c d")]


def words(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(winnowing.WORD.replace("\\\\", "\\"), lower)


def plain(tokens, hash_of):
    """Rolling hashes, and of each window the least, rightmost on ties: (hash, position) pairs."""
    h, k = [hash_of[t] for t in tokens], winnowing.GRAM
    grams = []
    if 0 < len(h) < k:
        x = 17
        for y in h:
            x = (x * 1_000_003 + y) % ((1 << 31) - 1)
        grams = [x]
    for i in range(len(h) - k + 1):
        x = h[i]
        for y in h[i + 1 : i + k]:
            x = (x * 1_000_003 + y) % ((1 << 31) - 1)
        grams.append(x)
    w = 1
    while w < winnowing.WINDOW and len(grams) >= 2 * w * winnowing.SPREAD:
        w *= 2
    return sorted({min(((grams[j], -j) for j in range(i, i + w))) for i in range(len(grams) - w + 1)}, key=lambda x: -x[1]), w


def shown(marks):
    return " ".join(f"{h:x}@{-i}" for h, i in marks)


def jaccard(a, b):
    a, b = {h for h, _ in a}, {h for h, _ in b}
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize("table", ["documents", "odd"])
def test_against_plain_winnowing(spark, table):
    df = spark.read.parquet(f"{DATA}/documents.parquet") if table == "documents" else spark.createDataFrame([(i, t, "k", 2) for i, t in ODD], "doc_id long, text string, a string, n_chars int")
    rows = sorted(((r["doc_id"], r["text"] or "") for r in df.collect()))
    got = sorted(winnowing.fingerprints(df).collect(), key=lambda r: r["doc_id"])
    edits = []
    for i, (_, text) in enumerate(rows):
        q = len(text) // 4
        edits.append(text[: len(text) - q] + rows[(i + 1) % len(rows)][1][:q])
    every = sorted({t for _, text in rows for t in words(text)} | {t for e in edits for t in words(e)})
    hash_of = {r["t"]: r["h"] for r in spark.createDataFrame([(t,) for t in every], "t string").select("t", F.expr("pmod(xxhash64(t), 2147483647L)").alias("h")).collect()}
    marks = [plain(words(t), hash_of)[0] for _, t in rows]
    for i, r in enumerate(got):
        text, edited = rows[i][1], edits[i]
        own = plain(words(edited), hash_of)[0]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (shown(marks[i]), shown(own))
        assert r["near_edited"] == pytest.approx(jaccard(marks[i], own)) and r["near_next"] == pytest.approx(jaccard(marks[i], marks[(i + 1) % len(rows)]))
        w = plain(words(text), hash_of)[1]
        places = [-1, *(-p for _, p in marks[i]), max(0, len(words(text)) - winnowing.GRAM) + 1]
        assert max(b - a for a, b in zip(places[:-1], places[1:], strict=True)) <= w or not marks[i]


def test_short_and_unspaced_texts_keep_marks(spark):
    short = [(i, " ".join(f"t{i}w{j}" for j in range(n))) for i, n in enumerate(range(5, 40))]
    han = [(1000 + i, "".join(chr(0x4E00 + (i * 97 + j * 31) % 5000) for j in range(60))) for i in range(10)]
    code = [(2000, "x=" * 400 + "".join(f"f{i}(a{i});" for i in range(300)))]
    found = winnowing.fingerprints(spark.createDataFrame(short + han + code, "doc_id long, text string")).collect()
    assert min(r["near_edited"] for r in found) > 0.15 and max(r["near_next"] for r in found if r["doc_id"] < 39) == 0
    assert winnowing.fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_null_ids_and_one_row(spark):
    rows = spark.createDataFrame([(None, "a b c d"), (None, "e f g h"), (3, "i j k l")], "doc_id long, text string")
    assert winnowing.fingerprints(rows).count() == 3
    one = winnowing.fingerprints(rows.where("doc_id = 3")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
