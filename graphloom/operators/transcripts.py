"""Session logs: lines of JSON, of which several may belong to one message, as usage, tools, prompts and active time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import iso_to_epoch, nonneg, tool_name

#: Token fields of a message by our names, beginnings of messages that nobody typed.
USAGE = {"input": "input_tokens", "output": "output_tokens", "cache_creation": "cache_creation_input_tokens", "cache_read": "cache_read_input_tokens"}
NOTICES = ("[Request interrupted", "<task-notification>")


def _text(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def entries(lines: DataFrame, server: str) -> DataFrame:
    """One row per line that is an object: type, time, message id, model, usage, tool calls, whether a typed prompt, context that our hooks added.

    lines: session, ord, value. `content` may be a text or a list of blocks.
    """
    e = lines.withColumn("e", F.try_parse_json("value")).where(F.startswith(F.schema_of_variant("e"), F.lit("OBJECT")))
    content = F.try_variant_get("e", "$.message.content", "variant")
    is_text = F.schema_of_variant(content) == "STRING"
    blocks = F.coalesce(F.when(F.startswith(F.schema_of_variant(content), F.lit("ARRAY")), F.try_variant_get(content, "$", "array<variant>")), F.array().cast("array<variant>"))
    of = lambda kind: F.filter(blocks, lambda b: _text(b, "$.type") == kind)
    joined = F.array_join(F.transform(of("text"), lambda b: F.coalesce(_text(b, "$.text"), F.lit(""))), "\n")
    text = F.when(is_text, F.try_variant_get(content, "$", "string")).otherwise(joined)
    flag = lambda name: F.coalesce(F.try_variant_get("e", f"$.{name}", "boolean"), F.lit(False))
    tools = F.transform(of("tool_use"), lambda b: F.struct(_text(b, "$.id").alias("id"), tool_name(F.coalesce(_text(b, "$.name"), F.lit("?")), server).alias("tool")))
    e = e.select(
        "session", "ord", _text(F.col("e"), "$.type").alias("type"), iso_to_epoch(_text(F.col("e"), "$.timestamp")).alias("at"), _text(F.col("e"), "$.version").alias("version"),
        flag("isMeta").alias("meta"), flag("isSidechain").alias("side"), flag("isCompactSummary").alias("compacted"),
        F.coalesce(_text(F.col("e"), "$.message.id"), _text(F.col("e"), "$.requestId"), _text(F.col("e"), "$.uuid")).alias("message"), _text(F.col("e"), "$.message.model").alias("model"),
        F.try_variant_get("e", "$.message.usage", "variant").isNotNull().alias("has_usage"), *[nonneg(F.try_variant_get("e", f"$.message.usage.{f}", "variant")).alias(n) for n, f in USAGE.items()],
        text.alias("text"), (F.size(of("tool_result")) > 0).alias("result"), tools.alias("tools"), F.try_variant_get("e", "$.attachment", "variant").alias("attachment"),
    )
    typed = F.ltrim(F.coalesce("text", F.lit("")))
    prompt = (F.col("type") == "user") & ~F.col("meta") & ~F.col("side") & ~F.col("compacted") & ~F.col("result") & (typed != "")
    for notice in NOTICES:
        prompt = prompt & ~F.startswith(typed, F.lit(notice))
    return e.withColumn("is_prompt", F.coalesce(prompt, F.lit(False))).withColumn("injected", injected_chars(server)).drop("attachment")


def injected_chars(server: str) -> Column:
    """Characters of context that a hook of ours added: a session's start, additional context, or feedback in a meta line."""
    a, mark = F.col("attachment"), f"[{server}]"
    kind = _text(a, "$.type")
    start = F.when((_text(a, "$.hookEvent") == "SessionStart") & F.startswith(_text(a, "$.command"), F.lit(f"{server} hook")), F.length(F.coalesce(_text(a, "$.stdout"), F.lit(""))))
    one = F.try_variant_get(a, "$.content", "string")
    items = F.coalesce(F.try_variant_get(a, "$.content", "array<string>"), F.array(one))
    added = F.aggregate(F.filter(items, lambda x: F.startswith(x, F.lit(mark))), F.lit(0), lambda n, x: n + F.length(x))
    own = F.when(kind == "hook_success", start).when(kind == "hook_additional_context", added)
    back = F.when((F.col("type") == "user") & F.col("meta") & F.contains("text", F.lit(mark)), F.length("text"))
    return F.coalesce(F.when(F.col("type") == "attachment", own), back, F.lit(0)).cast("long")


def usage(e: DataFrame) -> DataFrame:
    """Tokens by session, model and whether delegated: repeated lines of a message count once, each field by its most, model and side by the last line."""
    rows = e.where((F.col("type") == "assistant") & F.col("has_usage") & F.col("model").isNotNull() & ~F.startswith("model", F.lit("<")) & F.col("message").isNotNull())
    once = rows.groupBy("session", "message").agg(*[F.max(n).alias(n) for n in USAGE], F.max_by(F.struct("model", "side"), "ord").alias("last"))
    return once.groupBy("session", F.col("last.model").alias("model"), F.col("last.side").alias("delegated")).agg(*[F.sum(n).cast("long").alias(n) for n in USAGE])


def tool_counts(e: DataFrame) -> DataFrame:
    """Different calls of each tool; a call without an id counts on its own."""
    calls = e.where("type = 'assistant'").select("session", "ord", F.posexplode("tools").alias("i", "t"))
    once = calls.groupBy("session", F.coalesce("t.id", F.concat_ws("/", F.col("ord").cast("string"), F.col("i").cast("string"))).alias("call")).agg(F.min_by("t.tool", F.struct("ord", "i")).alias("tool"))
    return once.groupBy("session", "tool").agg(F.count("*").alias("n"))


def active_seconds(e: DataFrame) -> DataFrame:
    """Active seconds per session: from each prompt to the last line that counts before the next one."""
    w = Window.partitionBy("session").orderBy("ord")
    s = e.withColumn("part", F.sum(F.col("is_prompt").cast("int")).over(w))
    counts = F.col("is_prompt") | (F.col("at").isNotNull() & (F.col("type") != "queue-operation"))
    opens = F.col("at").isNotNull() & (F.col("is_prompt") | F.col("type").isin("assistant", "user"))
    s = s.where(counts).groupBy("session", "part").agg(F.min_by("at", F.when(opens, F.col("ord"))).alias("start"), F.min(F.when(opens, F.col("ord"))).alias("first"), F.collect_list(F.struct("ord", "at")).alias("rows"))
    last = F.array_max(F.transform(F.filter("rows", lambda r: r["ord"] >= F.col("first")), lambda r: r["at"]))
    return s.groupBy("session").agg(F.round(F.coalesce(F.sum(F.greatest(last - F.col("start"), F.lit(0.0))), F.lit(0.0)), 3).alias("active_s"))


def session_totals(e: DataFrame) -> DataFrame:
    """One row per session: prompts, injected characters, active seconds, tokens of the main conversation and delegated ones, calls of tools."""
    base = e.groupBy("session").agg(F.count_if("is_prompt").alias("prompts"), F.sum("injected").cast("long").alias("injected_chars"), F.max_by("version", F.when(F.col("version").isNotNull(), F.col("ord"))).alias("version"))
    total = sum((F.col(n) for n in USAGE), F.lit(0))
    u = usage(e).groupBy("session").agg(F.coalesce(F.sum(F.when(~F.col("delegated"), total)), F.lit(0)).cast("long").alias("main"), F.coalesce(F.sum(F.when(F.col("delegated"), total)), F.lit(0)).cast("long").alias("delegated"))
    t = tool_counts(e).groupBy("session").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("tool", "n")))).alias("tools"))
    return base.join(active_seconds(e), "session", "left").join(u, "session", "left").join(t, "session", "left").na.fill(0, ["main", "delegated"]).na.fill(0.0, ["active_s"])


def turn_rows(e: DataFrame) -> DataFrame:
    """One row per prompt of a session and what followed it: lines, tokens that its last messages name, tools."""
    w = Window.partitionBy("session").orderBy("ord")
    s = e.withColumn("turn", F.sum(F.col("is_prompt").cast("int")).over(w))
    once = s.where((F.col("type") == "assistant") & F.col("message").isNotNull()).groupBy("session", "turn", "message").agg(F.max(sum((F.col(n) for n in USAGE), F.lit(0))).alias("tokens"))
    tokens = once.groupBy("session", "turn").agg(F.sum("tokens").cast("long").alias("tokens"))
    return s.groupBy("session", "turn").agg(F.count("*").alias("lines"), F.sum(F.size("tools")).cast("long").alias("calls")).join(tokens, ["session", "turn"], "left").na.fill(0, ["tokens"])
