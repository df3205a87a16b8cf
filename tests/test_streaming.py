"""Logs that arrive in parts give the same totals as whole ones."""

import json

from graphloom.operators import transcripts
from graphloom.streaming import turns


def line(t, kind, **more):
    return json.dumps({"type": kind, "timestamp": f"2026-01-01T00:00:{t:02d}Z", **more})


def message(t, id_, output, *tools):
    return line(t, "assistant", message={"id": id_, "model": "m", "usage": {"input_tokens": 5, "output_tokens": output}, "content": [{"type": "tool_use", "id": x, "name": "Read"} for x in tools]})


def test_increments_equal_a_full_read(spark, tmp_path):
    parts = [
        {"s1": [line(0, "user", message={"content": "hi"}), message(3, "m1", 10, "t1")], "s2": [message(1, "m9", 4)]},
        {"s1": [message(4, "m1", 30, "t1", "t2"), "broken {"], "s2": [line(9, "user", message={"content": "go"}), message(12, "m9", 2)]},
    ]
    logs, out, check = tmp_path / "logs", str(tmp_path / "out"), str(tmp_path / "check")
    logs.mkdir()
    for i, part in enumerate(parts):
        for session, rows in part.items():
            (logs / f"{session}~{i}.jsonl").write_text("\n".join(rows) + "\n")
        turns.collect_lines(spark, str(logs), out, check).awaitTermination()
        turns.collect_lines(spark, str(logs), out, check).awaitTermination()  # nothing new
    whole = [(s, i * 1000 + j, r) for i, part in enumerate(parts) for s, rows in part.items() for j, r in enumerate(rows)]
    want = transcripts.session_totals(transcripts.entries(spark.createDataFrame(whole, "session string, ord long, value string"), "own"))
    got = turns.sessions_so_far(spark, out, "own")
    rows = lambda df: {r["session"]: (r["prompts"], r["main"], r["active_s"], r["tools"]) for r in df.collect()}
    assert rows(got) == rows(want) == {"s1": (1, 35, 4.0, {"Read": 2}), "s2": (1, 9, 3.0, None)}
