"""Repair against exhaustive search, the two ways through an operator against each other, and odd rows."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from graphloom.llm import conversation_repair as repair
from graphloom.llm.queries import op11_conversation_repair

DATA = "/root/testdata/sf0.01"
LEGAL = re.compile("(s?(ua)+)?")
BLANKS = " \t\n\v\f\r"


def searched(rows):
    """Cheapest edits and their least labels by uniform-cost search over whole strings: (cost, labels, repaired rows)."""
    seen, faults = set(), []
    for role, text in rows:
        bare = text.strip(BLANKS)
        faults.append("x" if not bare or (role, text) in seen else "" if bare[-1] in ".!?" else "t")
        seen.add((role, text))
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, labels, at, initials, out = heapq.heappop(heap)
        if at == len(rows) and LEGAL.fullmatch(initials):
            return cost, labels, list(out)
        # an unfinished path's labels may be the start of another's, so nothing is merged but equal states
        if (labels, at, initials) in done:
            continue
        done.add((labels, at, initials))
        if len(initials) > 2 * len(rows) + 4 or not re.fullmatch("(s?(ua)*u?)?", initials):
            continue
        for role in ("user", "assistant"):
            heapq.heappush(heap, (cost + 2, labels + "I", at, initials + role[0], (*out, (role, ""))))
        if at < len(rows):
            role, text = rows[at]
            heapq.heappush(heap, (cost + 3, labels + "D", at + 1, initials, out))
            if faults[at] != "x":
                more = faults[at] == "t"
                if role[:1] in ("s", "u", "a"):
                    heapq.heappush(heap, (cost + more, labels + "K", at + 1, initials + role[0], (*out, (role, text))))
                for new in ("user", "assistant"):
                    heapq.heappush(heap, (cost + 2 + more, labels + "R", at + 1, initials + new[0], (*out, (new, text))))


def told(rows):
    """The plain report of rows (turn, role, text) in order."""
    plain = [r[1:] for r in rows]
    cost, labels, out = searched(plain)
    counts, seen = {"blank": 0, "duplicate": 0, "truncated": 0}, []
    for row in plain:
        bare = row[1].strip(BLANKS)
        fault = "blank" if not bare else "duplicate" if row in seen else "truncated" if bare[-1] not in ".!?" else None
        seen.append(row)
        if fault:
            counts[fault] += 1
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum((a[0][:1] + b[0][:1]) not in ("su", "ua", "au") for a, b in itertools.pairwise(plain))
    sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    return (gaps, *counts.values(), illegal, cost, labels, sha)


def test_shortest_path_against_search():
    r = random.Random(5)
    for _ in range(400):
        rows = [(r.choice(["system", "user", "assistant", "user", "assistant", "tool", ""]), r.choice(["a.", "b?", "cut", " ", "é!", "a."])) for _ in range(r.randint(0, 5))]
        cost, labels, out = searched(rows)
        report, mended = repair.mended([(k, *row) for k, row in enumerate(rows)])
        assert (report["cost"], report["audit"]) == (cost, labels)
        assert mended == out


def test_blocks_chain_to_the_whole():
    r = random.Random(6)
    for _ in range(400):
        marks = "".join(r.choice("suaSUAx?!uauaua") for _ in range(r.randint(1, 40)))
        cuts = sorted({0, len(marks), *(r.randint(0, len(marks)) for _ in range(r.randint(0, 6)))})
        cost, pieces, behind = repair.chained([repair.matrix(marks[a:b]) for a, b in itertools.pairwise(cuts)])
        assert (cost, "".join(p for p, _ in pieces) + behind) == repair.shortest(marks, repair.ENDS)[0]


def damage(rows):
    """Plain damage of (conv, turn, role, text) by conversation, in order."""
    out = {}
    for conv, turn, role, text in rows:
        own = out.setdefault(conv, [])
        role, text = (" " if x is None else x for x in (role, text))
        fate = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
        if fate == 0:
            continue
        row = (turn, "user" if fate == 4 else role, "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text)
        own += [row] * (2 if fate == 3 else 1)
    for own in out.values():
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
    return out


def check(found, rows):
    expected = damage(rows)
    assert len(found) == len(expected)
    for row in found:
        assert tuple(row)[1:] == told(expected[row["conv_id"]]), row["conv_id"]


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = op11_conversation_repair(spark, DATA).collect()
    assert found[0].asDict().keys() == {"conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"}
    check(found, rows)


def odd_rows():
    r = random.Random(8)
    rows = [(r.choice([None, 1, 2, 3]), r.choice([None, *range(6)]), r.choice(["user", "assistant", "system", None]), r.choice(["Yes.", "no", None, "", "Why?", "x" * 50])) for _ in range(26)]
    return [*rows, (9, 4, "user", "Same."), (9, 4, "user", "Same."), (7, None, "user", "\t"), (6, 1 << 60, "system", "S.")]


def test_nulls_ties_and_extra_columns(spark):
    rows = odd_rows()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, key string, block int")
    check(repair.repair_digest(df).collect(), rows)


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.repair_digest(df).count() == 0
    assert repair.repaired_turns(df).count() == 0


def test_everything_dropped(spark):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    got = repair.repair_digest(spark.createDataFrame([(conv, 1, "user", "Hi.")], "conv_id long, turn long, role string, text string")).collect()
    assert [tuple(r) for r in got] == [(conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


@pytest.fixture(scope="module")
def many(spark):
    """One conversation with most of the rows, some of them repeated very often, beside short ones."""
    r = random.Random(11)
    rows = [(5, i // 2, ["system", "user", "assistant"][r.randint(0, 2)], r.choice(["Same text.", f"text {i}.", f"cut {i}", ""])) for i in range(700)]
    rows += [(c, t, "user" if t % 2 == 0 else "assistant", f"{c} {t}.") for c in range(20) for t in range(4) if c != 5]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)


def test_long_conversations_in_blocks(spark, many):
    whole = {r["conv_id"]: r for r in repair.repair_digest(many).collect()}
    for rows, block in ((2, 7), (100, 64)):
        parts = {r["conv_id"]: r for r in repair.structure_report(repair.damaged(many), F.col("gone"), long_rows=rows, block_rows=block).collect()}
        assert parts == whole
    assert whole[5]["duplicate"] > 100 and len(whole[5]["audit"]) > 600


def test_repaired_rows_are_what_the_report_hashes(spark, many):
    damaged = repair.damaged(many)
    for limits in ({}, {"long_rows": 3, "block_rows": 10}):
        report = {r["conv_id"]: r["repaired_sha256"] for r in repair.structure_report(damaged, F.col("gone"), **limits).collect()}
        turns = {}
        for r in repair.repaired_turns(damaged, F.col("gone"), **limits).orderBy("conv_id", "place").collect():
            turns.setdefault(r["conv_id"], []).append((r["place"], f"{r['role']}:{r['text']}"))
        for conv, own in turns.items():
            assert [p for p, _ in own] == list(range(len(own)))
            assert LEGAL.fullmatch("".join(t[0] for _, t in own))
            assert hashlib.sha256("\n".join(t for _, t in own).encode()).hexdigest() == report[conv]
