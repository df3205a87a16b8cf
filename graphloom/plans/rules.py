"""Queries of the text rules, logs and store changes over the driver's tables, with their DuckDB counterparts."""

from __future__ import annotations


import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..extraction import prose
from ..extraction.tables import normal_path
from ..functions import text as tx
from ..functions import values as va
from ..operators import activity, classify, graph, prompts, snapshot, transcripts
from ..sources.files import diff_added, line_stats
from ..sources.store import resolved, touched
from . import relations as rel
from .relations import duck

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
SERVER = "graph"


def _q(name: str, sql: str, f) -> None:
    QUERIES[name] = f
    if sql:
        ORACLES[name] = sql


def _t(s: SparkSession, d: str, name: str) -> DataFrame:
    return rel.table(s, d, name)


def _parts(s: SparkSession, d: str, **columns) -> DataFrame:
    """Columns over the events, k being the number in their properties."""
    e = _t(s, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return e.select("event_id", *[F.expr(c).alias(n) for n, c in columns.items()])


_K = "(SELECT *, json_extract_string(props,'$.k')::BIGINT AS k FROM events)"

# values
_CATEGORY = "CASE k%9 WHEN 0 THEN 'Bug-fix' WHEN 1 THEN ' locate and  explain ' WHEN 2 THEN 'triage failing tests or logs' WHEN 3 THEN 'My own_category of a very long name '||k WHEN 4 THEN '!!' WHEN 5 THEN 'tests' WHEN 6 THEN 'small feature' WHEN 7 THEN 'refactoring' ELSE NULL END"
_q("fn_norm_category", f"SELECT event_id, CASE k%9 WHEN 0 THEN 'bug_fix' WHEN 1 THEN 'explain' WHEN 2 THEN 'triage' WHEN 3 THEN 'my_own_category_of_a_very_long' WHEN 5 THEN 'tests' WHEN 6 THEN 'feature' WHEN 7 THEN 'refactor' END AS slug FROM {_K}", lambda s, d: _parts(s, d, c=_CATEGORY).select("event_id", va.norm_category(F.col("c")).alias("slug")))
_q("fn_norm_size", f"SELECT event_id, CASE k%6 WHEN 0 THEN 'S' WHEN 1 THEN 'M' WHEN 2 THEN 'L' END AS size FROM {_K}", lambda s, d: _parts(s, d, c="CASE k%6 WHEN 0 THEN ' small task' WHEN 1 THEN 'M' WHEN 2 THEN 'Large' WHEN 3 THEN 'medium-ish' WHEN 4 THEN 'Middle' ELSE '' END").select("event_id", va.norm_size(F.col("c")).alias("size")))
_q("fn_nonneg_int", f"SELECT event_id, CASE k%5 WHEN 0 THEN k ELSE 0 END AS n FROM {_K}", lambda s, d: _parts(s, d, c="CASE k%5 WHEN 0 THEN cast(k as string) WHEN 1 THEN concat('\"', k, '\"') WHEN 2 THEN 'true' WHEN 3 THEN concat('-', k + 1) ELSE 'null' END").select("event_id", va.nonneg(F.try_parse_json("c")).alias("n")))
_q("fn_tool_name", f"SELECT event_id, CASE k%5 WHEN 0 THEN 'graph:find' WHEN 1 THEN 'graph:map' WHEN 2 THEN 'mcp' WHEN 3 THEN 'mcp' ELSE 'Read' END AS tool FROM {_K}", lambda s, d: _parts(s, d, c="CASE k%5 WHEN 0 THEN 'mcp__graph__find' WHEN 1 THEN 'mcp__plugin_graph_graph__map' WHEN 2 THEN 'mcp__other__find' WHEN 3 THEN 'mcp__graph__a-b' ELSE 'Read' END").select("event_id", va.tool_name(F.col("c"), SERVER).alias("tool")))
_q("fn_tier", f"SELECT event_id, CASE k%4 WHEN 0 THEN 'opus' WHEN 1 THEN 'sonnet' WHEN 2 THEN 'haiku' ELSE 'other-'||k END AS tier FROM {_K}", lambda s, d: _parts(s, d, c="CASE k%4 WHEN 0 THEN 'big-OPUS-haiku' WHEN 1 THEN 'x-sonnet-1' WHEN 2 THEN 'Haiku' ELSE concat('other-', k) END").select("event_id", va.tier(F.col("c")).alias("tier")))
_q("fn_iso_to_epoch", "SELECT event_id, epoch(ts)::DOUBLE AS at FROM events", lambda s, d: _parts(s, d, c="date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'\")").select("event_id", va.iso_to_epoch(F.col("c")).alias("at")))
_q("fn_epoch_to_day", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS day FROM events", lambda s, d: _t(s, d, "events").select("event_id", va.epoch_to_day(F.unix_seconds(F.col("ts").cast("timestamp"))).alias("day")))
_q("fn_format_duration", "SELECT o_orderkey, CASE WHEN r >= 60 THEN (r//60)||'m '||lpad((r%60)::VARCHAR, 2, '0')||'s' ELSE r||'s' END AS t FROM (SELECT o_orderkey, o_custkey AS r FROM orders)", lambda s, d: _t(s, d, "orders").select("o_orderkey", va.duration(F.col("o_custkey").cast("double")).alias("t")))
_q("fn_content_hash", "SELECT doc_id, md5(text) AS hash FROM documents", lambda s, d: _t(s, d, "documents").select("doc_id", F.md5("text").alias("hash")))
_q("fn_symbol_hash", "SELECT l_orderkey, l_linenumber, md5(l_returnflag||chr(1)||l_linestatus||chr(1)||l_partkey) AS hash FROM lineitem", lambda s, d: _t(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.md5(F.concat_ws("\x01", "l_returnflag", "l_linestatus", F.col("l_partkey").cast("string"))).alias("hash")))
_q("fn_fingerprint", "SELECT md5(string_agg(key||'='||v, ';' ORDER BY key)) AS fingerprint FROM (SELECT c_mktsegment AS key, count(*)::VARCHAR AS v FROM customer GROUP BY 1)", lambda s, d: _t(s, d, "customer").groupBy("c_mktsegment").agg(F.count("*").cast("string").alias("v")).agg(F.md5(F.array_join(F.array_sort(F.collect_list(F.concat("c_mktsegment", F.lit("="), "v"))), ";")).alias("fingerprint")))
# text
_q("fn_shard_stem", "SELECT k, CASE k%5 WHEN 0 THEN '_root' WHEN 1 THEN 'a~~b/c' WHEN 2 THEN 'x/__index' WHEN 3 THEN '___root/y' ELSE 'src/p'||k END AS stem FROM (SELECT p_partkey AS k FROM part)", lambda s, d: _t(s, d, "part").select(F.col("p_partkey").alias("k"), tx.shard_stem(F.expr("CASE p_partkey%5 WHEN 0 THEN '' WHEN 1 THEN 'a~b/c' WHEN 2 THEN 'x/_index' WHEN 3 THEN '__root/y' ELSE concat('src/p', p_partkey) END")).alias("stem")))
_q("fn_split_qualified", "SELECT p_partkey AS k, 'run'||p_partkey AS last, CASE WHEN p_partkey%3=0 THEN NULL ELSE 'A.b'||p_size END AS parent FROM part", lambda s, d: _t(s, d, "part").withColumn("q", F.expr("CASE p_partkey%3 WHEN 0 THEN concat(' run', p_partkey, '() ') WHEN 1 THEN concat('A::b', p_size, '#run', p_partkey) ELSE concat('A.b', p_size, '..run', p_partkey, '()') END")).select(F.col("p_partkey").alias("k"), tx.last_part(F.col("q")).alias("last"), tx.leading_parts(F.col("q")).alias("parent")))
_q("fn_normalize_signature", "SELECT p_partkey AS k, 'f'||p_partkey||'(a, b)' AS sig FROM part", lambda s, d: _t(s, d, "part").select(F.col("p_partkey").alias("k"), tx.normalize_signature(F.expr("concat('f', p_partkey, '( a,\n  b, ) {')")).alias("sig")))
_q("fn_clean_name", "SELECT p_partkey AS k, 'a b'||p_size AS name FROM part", lambda s, d: _t(s, d, "part").select(F.col("p_partkey").alias("k"), tx.clean_name(F.expr("concat('`a \n b', p_size, '`')")).alias("name")))
_q("fn_license_pragma", "SELECT p_partkey AS k, p_partkey%4 IN (0, 1) AS licence, p_partkey%4=2 AS pragma FROM part", lambda s, d: _t(s, d, "part").withColumn("t", F.expr("CASE p_partkey%4 WHEN 0 THEN 'Copyright 2020 X' WHEN 1 THEN 'SPDX-License-Identifier: MIT' WHEN 2 THEN ' noqa' ELSE 'the noqa of licenceless words' END")).select(F.col("p_partkey").alias("k"), tx.license_line(F.col("t")).alias("licence"), tx.pragma_line(F.col("t")).alias("pragma")))
_q("fn_remote_url_parse", "SELECT p_partkey AS k, CASE p_partkey%5 WHEN 0 THEN 'github' WHEN 1 THEN 'gitlab' WHEN 2 THEN 'azure' WHEN 3 THEN 'github' END AS kind, CASE p_partkey%5 WHEN 0 THEN 'https://github.com/t'||p_size||'/r' WHEN 1 THEN 'https://gitlab.example.org/a/b/r'||p_size WHEN 2 THEN 'https://dev.azure.com/o/p/_git/r'||p_size WHEN 3 THEN 'https://github.com/t/r'||p_size END AS web FROM part", lambda s, d: _t(s, d, "part").select(F.col("p_partkey").alias("k"), tx.remote_url(F.expr("CASE p_partkey%5 WHEN 0 THEN concat('git@github.com:t', p_size, '/r.git') WHEN 1 THEN concat('ssh://git@GitLab.example.org:22/a/b/r', p_size, '.git') WHEN 2 THEN concat('git@ssh.dev.azure.com:v3/o/p/r', p_size) WHEN 3 THEN concat('https://user:pw@github.com/t/r', p_size, '/') ELSE 'https://host.example/x/y' END")).alias("r")).select("k", "r.kind", "r.web"))
_q("fn_url_quote", "SELECT p_partkey AS k, 'a%20b/%C3%A9%3F'||p_size AS q FROM part", lambda s, d: _t(s, d, "part").select(F.col("p_partkey").alias("k"), tx.url_quote(F.expr("concat('a b/é?', p_size)")).alias("q")))
_q("fn_label_match", "SELECT p_partkey AS k, CASE p_partkey%3 WHEN 0 THEN 'Bug' WHEN 1 THEN 'docs' ELSE 'unclear' END AS label FROM part", lambda s, d: _t(s, d, "part").select(F.col("p_partkey").alias("k"), tx.label_match(F.expr("CASE p_partkey%3 WHEN 0 THEN ' bug ' WHEN 1 THEN 'I think Docs.' ELSE 'none' END"), ("Bug", "docs")).alias("label")))
_q("fn_front_matter", "SELECT p_partkey AS k, 'v'||p_size AS v, 2 AS n FROM part", lambda s, d: _t(s, d, "part").withColumn("m", tx.front_matter(F.expr("concat('---\nkey: old\nother: x: y\nno pair\nkey:  v', p_size, '\n---\nkey: body')"))).select(F.col("p_partkey").alias("k"), F.try_element_at("m", F.lit("key")).alias("v"), F.size("m").alias("n")))
_q("fn_open_questions", "SELECT p_partkey AS k, 'q'||p_size||'|last' AS open FROM part", lambda s, d: _t(s, d, "part").select(F.col("p_partkey").alias("k"), F.array_join(tx.open_questions(F.expr("concat('- [ ] before\n## Open questions\n- [ ] q', p_size, '\n<!-- - [ ] no -->\n- [x] done\n * [ ] last\n## Next\n- [ ] after')")), "|").alias("open")))
_q("fn_clean_model_summary", "SELECT p_partkey AS k, CASE p_partkey%3 WHEN 0 THEN 'Adds '||p_size||' parts.' WHEN 1 THEN NULL ELSE repeat('x', 119)||'…' END AS line FROM part", lambda s, d: _t(s, d, "part").select(F.col("p_partkey").alias("k"), tx.clean_model_summary(F.expr("CASE p_partkey%3 WHEN 0 THEN concat('\n \"Summary: Adds ', p_size, ' parts.\"\nmore') WHEN 1 THEN 'Sorry, no' ELSE repeat('x', 130) END")).alias("line")))
_q("fn_is_readme", "SELECT p_partkey AS k, p_partkey%2=0 AS readme FROM part", lambda s, d: _t(s, d, "part").select(F.col("p_partkey").alias("k"), tx.is_readme(F.expr("CASE p_partkey%4 WHEN 0 THEN 'a/README.md' WHEN 1 THEN 'a/README.py' WHEN 2 THEN 'Readme' ELSE 'x/not_readme.md' END")).alias("readme")))
# tags, replies
_TAGGED = "CASE p_partkey%4 WHEN 0 THEN '# @ai:todo T'||p_size||' — tidy up' WHEN 1 THEN 'x = 1 /* @ai:assume a.b-'||p_size||': ids differ */' WHEN 2 THEN 'see `@ai:todo T1` in prose' ELSE '// @ai:change T2' END"
_lines = lambda s, d: _t(s, d, "part").select(F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("path"), F.lit(1).cast("long").alias("line"), F.expr(_TAGGED).alias("line_text"))
_TAGS = "SELECT 'f'||p_partkey AS path, 1::BIGINT AS line, CASE p_partkey%4 WHEN 0 THEN 'todo' WHEN 1 THEN 'assume' ELSE 'change' END AS kind, CASE p_partkey%4 WHEN 0 THEN 'T'||p_size WHEN 1 THEN 'a.b-'||p_size ELSE 'T2' END AS task, CASE p_partkey%4 WHEN 0 THEN 'tidy up' WHEN 1 THEN 'ids differ' ELSE '' END AS note FROM part WHERE p_partkey%4 <> 2"
_q("cl_anchor_parse", _TAGS, lambda s, d: classify.tags(_lines(s, d)))
_q("agg_manifest_counts", f"SELECT path, count_if(kind='review')::BIGINT AS review, count_if(kind='assume')::BIGINT AS assume, count_if(kind='todo')::BIGINT AS todo, count_if(kind='change')::BIGINT AS change FROM ({_TAGS}) GROUP BY path", lambda s, d: classify.tag_counts(classify.tags(_lines(s, d))))
_q("cl_anchor_strip", "SELECT 'f'||p_partkey AS path, 'a' || chr(10) || 'b' AS text, 1::BIGINT AS removed FROM part WHERE p_partkey%4=3 OR (p_partkey%4=0 AND p_size=2)", lambda s, d: classify.strip_tags(_lines(s, d).select("path", F.concat(F.lit("a\n"), "line_text", F.lit("\nb")).alias("text")), "T2").select("path", "text", "removed"))
_stats = lambda s, d: _t(s, d, "part").select(F.concat(F.lit("f"), F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 8 == 1, ".json").otherwise("")).alias("path"), F.when(F.col("p_partkey") % 5 == 0, "deleted").otherwise("modified").alias("status"), F.when(F.col("p_partkey") % 7 != 0, F.col("p_size")).cast("long").alias("added"), F.col("p_size").cast("long").alias("deleted"))
_STATS = "SELECT 'f'||p_partkey||CASE WHEN p_partkey%8=1 THEN '.json' ELSE '' END AS path, CASE WHEN p_partkey%5=0 THEN 'deleted' ELSE 'modified' END AS status, CASE WHEN p_partkey%7<>0 THEN p_size END::BIGINT AS added, p_size::BIGINT AS deleted FROM part"
_q("cl_missing_anchor", f"SELECT path, status, added, deleted FROM ({_STATS}) WHERE status<>'deleted' AND added IS NOT NULL AND NOT ends_with(path, '.json') AND path NOT IN (SELECT path FROM ({_TAGS}))", lambda s, d: classify.untagged(_stats(s, d), classify.tags(_lines(s, d)), ["*.json"]))
_q("cl_manifest_build", f"SELECT s.path, status, added, deleted, count(t.path) AS anchors, ends_with(s.path, '.json') OR added IS NULL AS exempt FROM ({_STATS}) s LEFT JOIN ({_TAGS}) t ON t.path=s.path GROUP BY ALL", lambda s, d: classify.manifest(classify.tags(_lines(s, d)), _stats(s, d), ["*.json"]))
_REPLY = "CASE k%7 WHEN 0 THEN 'Yes, approved!' WHEN 1 THEN 'ok, accept t'||k||' and commit' WHEN 2 THEN 'not approved' WHEN 3 THEN 'approve it later' WHEN 4 THEN 'I approve the plan T'||k WHEN 5 THEN 'accepted?' ELSE 'please add a cache' END"
_q("cl_reply", f"SELECT event_id, CASE k%7 WHEN 0 THEN 'approve' WHEN 1 THEN 'accept' WHEN 4 THEN 'approve' END AS kind, CASE WHEN k%7 IN (1, 4) THEN 'T'||k END AS task FROM {_K}", lambda s, d: (lambda e: e.select("event_id", classify.reply(F.col("c"))[0].alias("kind"), classify.reply(F.col("c"))[1].alias("task")))(_parts(s, d, c=_REPLY)))
_q("cl_contract_check", f"SELECT event_id, CASE WHEN k%3=0 THEN 'lines' WHEN k%3=1 THEN 'code' ELSE '' END AS problems FROM {_K}", lambda s, d: _parts(s, d, c="CASE k%3 WHEN 0 THEN repeat('a line\n', 9) WHEN 1 THEN 'a\n```py\n1\n2\n3\n' ELSE 'a\n```\n1\n```\nb' END").select("event_id", F.array_join(classify.answer_problems(F.col("c"), 6, 2), ",").alias("problems")))
# prompts
_PROMPT = "CASE k%10 WHEN 0 THEN '' WHEN 1 THEN '/help me' WHEN 2 THEN '!quick fix it' WHEN 3 THEN concat('please add a cache to `Store.get` in src/a', k, '.py, src/b.py and lib/c.ts') WHEN 4 THEN 'yes, and keep the old name' WHEN 5 THEN 'start the dev server' WHEN 6 THEN 'Where is retry_call used?' WHEN 7 THEN 'go ahead' WHEN 8 THEN concat('Goal: refactor part', k, '. Scope: a/b. Constraints: none') ELSE 'run the whole benchmark twice' END"
_prompts = lambda s, d: prompts.classified(_parts(s, d, c=_PROMPT), "event_id", "c")
_q("cl_prompt_kind", f"SELECT event_id, CASE k%10 WHEN 0 THEN 'empty' WHEN 1 THEN 'command' WHEN 2 THEN 'bypass' WHEN 3 THEN 'task' WHEN 4 THEN 'reply' WHEN 5 THEN 'action' WHEN 6 THEN 'question' WHEN 7 THEN 'reply' WHEN 8 THEN 'task' ELSE 'action' END AS kind FROM {_K}", lambda s, d: _prompts(s, d).select("event_id", "kind"))
_q("cl_labels", f"SELECT event_id, 'refactor part'||k AS goal, 'a/b' AS scope FROM {_K} WHERE k%10=8", lambda s, d: _prompts(s, d).where("fields['goal'] is not null").select("event_id", F.expr("fields['goal']").alias("goal"), F.expr("fields['scope']").alias("scope")))
_q("cl_candidates", f"SELECT event_id, CASE k%10 WHEN 3 THEN 'symbol:Store.get path:src/a'||k||'.py path:src/b.py path:lib/c.ts' WHEN 6 THEN 'symbol:retry_call' WHEN 8 THEN 'path:a/b' WHEN 1 THEN 'path:/help' END AS names FROM {_K} WHERE k%10 IN (1, 3, 6, 8)", lambda s, d: _prompts(s, d).where("size(names) > 0").select("event_id", F.array_join(F.transform("names", lambda n: F.concat(n["kind"], F.lit(":"), n["text"])), " ").alias("names")))
_q("cl_task_size", f"SELECT event_id, CASE WHEN k%10 IN (3, 8) THEN 'large' ELSE 'small' END AS size FROM {_K}", lambda s, d: _prompts(s, d).select("event_id", "size"))
_q("cl_missing_fields", f"SELECT event_id, CASE k%10 WHEN 2 THEN 'constraints' WHEN 3 THEN 'constraints' WHEN 4 THEN 'goal' WHEN 5 THEN 'constraints' WHEN 8 THEN '' ELSE 'goal,constraints' END AS missing FROM {_K}", lambda s, d: _prompts(s, d).select("event_id", F.array_join("missing", ",").alias("missing")))
# diffs
_DIFF = "concat('diff --git a/o', o_orderkey, '.py b/o', o_orderkey, '.py\n--- a/o', o_orderkey, '.py\n+++ b/o', o_orderkey, '.py\n@@ -1 +', o_custkey, ',2 @@\n+one ', o_orderkey, '\n-two\n+++ three\n')"
_q("scan_git_diff_added", "SELECT 'o'||o_orderkey||'.py' AS path, o_custkey AS line, 'one '||o_orderkey AS line_text FROM orders UNION ALL SELECT 'o'||o_orderkey||'.py', o_custkey+1, '++ three' FROM orders", lambda s, d: diff_added(_t(s, d, "orders").select(F.expr(_DIFF).alias("diff"))))
_side = lambda s, d, keep, text: _t(s, d, "lineitem").where(keep).select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("path"), F.col("l_linenumber").cast("long").alias("line"), F.expr(text).alias("line_text"))
_SIDE = "SELECT l_orderkey AS o, {} AS t FROM lineitem WHERE {}"
_q("scan_git_numstat", f"WITH a AS (SELECT o, t, count(*) AS n FROM ({_SIDE.format('l_returnflag', 'l_orderkey%5<>1')}) GROUP BY ALL), b AS (SELECT o, t, count(*) AS n FROM ({_SIDE.format('CASE WHEN l_orderkey%3=0 THEN l_returnflag ELSE l_linestatus END', 'l_orderkey%5<>2')}) GROUP BY ALL), j AS (SELECT coalesce(a.o, b.o) AS o, coalesce(a.n, 0) AS was, coalesce(b.n, 0) AS now FROM a FULL JOIN b ON a.o=b.o AND a.t=b.t) SELECT 'o'||o AS path, CASE WHEN sum(was)=0 THEN 'new' WHEN sum(now)=0 THEN 'deleted' ELSE 'modified' END AS status, sum(greatest(now-was, 0))::BIGINT AS added, sum(greatest(was-now, 0))::BIGINT AS deleted FROM j GROUP BY o HAVING sum(greatest(now-was, 0))>0 OR sum(greatest(was-now, 0))>0", lambda s, d: line_stats(_side(s, d, "l_orderkey % 5 <> 1", "l_returnflag"), _side(s, d, "l_orderkey % 5 <> 2", "CASE WHEN l_orderkey % 3 = 0 THEN l_returnflag ELSE l_linestatus END")))
# session logs: four events a message, so a message stands on several lines
_LINE = """CASE event_type
 WHEN 'click' THEN concat('{"type":"assistant","timestamp":"', t, '","isSidechain":', cast(k % 4 = 0 as string), ',"message":{"id":"m', event_id div 40, '","model":"', CASE WHEN k % 11 = 0 THEN '<synthetic>' ELSE 'm-a' END, '","usage":{"input_tokens":', k, ',"output_tokens":"', k, '"},"content":[{"type":"tool_use","id":"u', k % 20, '","name":"mcp__graph__find"},{"type":"text","text":"x"}]}}')
 WHEN 'signup' THEN concat('{"type":"user","timestamp":"', t, '","message":{"content":"', CASE k % 4 WHEN 0 THEN '[Request interrupted by user]' WHEN 1 THEN '  ' ELSE 'please go on' END, '"}}')
 WHEN 'view' THEN concat('{"type":"attachment","timestamp":"', t, '","attachment":{"type":"hook_additional_context","content":["[graph] ', k, '","other"]}}')
 WHEN 'purchase' THEN concat('{"type":"user","isMeta":true,"timestamp":"', t, '","message":{"content":[{"type":"text","text":"[graph] back"}]}}')
 ELSE concat('{"type":"queue-operation", broken ', k) END"""


def _log(s: SparkSession, d: str) -> DataFrame:
    e = _t(s, d, "events").withColumns({"k": F.get_json_object("props", "$.k").cast("long"), "t": F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")})
    return transcripts.entries(e.select(F.col("user_id").alias("session"), F.col("event_id").alias("ord"), F.expr(_LINE).alias("value")), SERVER)


_ONCE = f"SELECT user_id AS session, event_id//40 AS m, max(k) AS k, arg_max(k%4=0, event_id) AS side FROM {_K} WHERE event_type='click' AND k%11<>0 GROUP BY ALL"
_CALLS = f"SELECT user_id AS session, count(DISTINCT k%20) AS n FROM {_K} WHERE event_type='click' GROUP BY user_id"
_q("agg_usage_max", f"SELECT session, side AS delegated, sum(k)::BIGINT AS input FROM ({_ONCE}) GROUP BY ALL", lambda s, d: transcripts.usage(_log(s, d)).select("session", "delegated", "input"))
_q("agg_tool_counts", f"SELECT session, 'graph:find' AS tool, n FROM ({_CALLS})", lambda s, d: transcripts.tool_counts(_log(s, d)))
_q("win_prompt_flag", f"SELECT event_id AS ord FROM {_K} WHERE event_type='signup' AND k%4 IN (2, 3)", lambda s, d: _log(s, d).where("is_prompt").select("ord"))
_q("fn_injected_chars", f"SELECT event_id AS ord, CASE event_type WHEN 'view' THEN 8+length(k::VARCHAR) ELSE 12 END::BIGINT AS injected FROM {_K} WHERE event_type IN ('view', 'purchase')", lambda s, d: _log(s, d).where("injected > 0").select("ord", "injected"))
_q("fn_text_of_content", f"SELECT event_id AS ord, CASE event_type WHEN 'click' THEN 'x' WHEN 'purchase' THEN '[graph] back' ELSE CASE k%4 WHEN 0 THEN '[Request interrupted by user]' WHEN 1 THEN '  ' ELSE 'please go on' END END AS text FROM {_K} WHERE event_type IN ('click', 'purchase', 'signup')", lambda s, d: _log(s, d).where("type <> 'attachment'").select("ord", "text"))
_q("agg_session_totals", f"SELECT b.session, prompts, injected, coalesce(main, 0) AS main, coalesce(delegated, 0) AS delegated FROM (SELECT user_id AS session, count_if(event_type='signup' AND k%4 IN (2, 3))::BIGINT AS prompts, sum(CASE event_type WHEN 'view' THEN 8+length(k::VARCHAR) WHEN 'purchase' THEN 12 ELSE 0 END)::BIGINT AS injected FROM {_K} WHERE event_type<>'error' GROUP BY 1) b LEFT JOIN (SELECT session, (sum(k) FILTER (NOT side))::BIGINT AS main, (sum(k) FILTER (side))::BIGINT AS delegated FROM ({_ONCE}) GROUP BY 1) u ON u.session=b.session", lambda s, d: transcripts.session_totals(_log(s, d)).select("session", "prompts", F.col("injected_chars").alias("injected"), "main", "delegated"))
_q("st_turn_rows", f"SELECT session, turn, count(*) AS lines FROM (SELECT user_id AS session, sum((event_type='signup' AND k%4 IN (2, 3))::INT) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS turn FROM {_K} WHERE event_type<>'error') GROUP BY ALL", lambda s, d: transcripts.turn_rows(_log(s, d)).select("session", "turn", "lines"))
_q("scan_jsonl_rows", f"SELECT event_id AS ord FROM {_K} WHERE event_type<>'error'", lambda s, d: _log(s, d).select("ord"))
# activity
_MODULES = lambda s, d: rel.turns(s, d).select("kind", "assisted", "session", F.lit("f").alias("source"), F.when(F.col("tokens") % 3 != 0, F.array(F.lit("query"))).otherwise(F.array(F.lit("review"))).alias("modules"), F.create_map(F.when(F.col("tool") == "view", "Read").when(F.col("tool") == "purchase", "graph:find").otherwise("Edit"), F.lit(1).cast("long")).alias("tools"))
_q("agg_unused_tools", duck("SELECT count(*) AS sessions, count_if(r>0 AND o=0)::BIGINT AS quiet FROM (SELECT session, count_if(tool='view') AS r, count_if(tool='purchase') AS o FROM turns WHERE kind='turn' AND assisted AND tokens%3<>0 GROUP BY session)", "turns"), lambda s, d: activity.unused_tools(_MODULES(s, d), "graph:"))
_q("agg_bench", duck("SELECT condition, round(median(d), 9) AS delta, count(*) AS n FROM (SELECT condition, (m-base)/base AS d FROM (SELECT task, condition, median(metric) AS m FROM runs GROUP BY 1, 2) JOIN (SELECT task, median(metric) AS base FROM runs WHERE condition='N' GROUP BY 1) USING (task) WHERE condition<>'N' AND base<>0) GROUP BY 1", "runs"), lambda s, d: activity.ablations(rel.runs(s, d), "N").withColumn("delta", F.round("delta", 9)))
_q("agg_bench_passing", duck("SELECT round(median(d), 9) AS delta, count(*) AS n FROM (SELECT (a-b)/b AS d FROM (SELECT task, median(metric) FILTER (condition='A') AS a, median(metric) FILTER (condition='N') AS b FROM runs WHERE passed GROUP BY task) WHERE a IS NOT NULL AND b IS NOT NULL AND b <> 0)", "runs"), lambda s, d: activity.headline(rel.runs(s, d), "A", "N", passing=True).withColumn("delta", F.round("delta", 9)))
_q("agg_median_exact", duck("SELECT task, median(metric) AS median FROM runs GROUP BY task", "runs"), lambda s, d: activity.exact_medians(rel.runs(s, d).select("task", F.col("metric").alias("x")), ["task"]))
_TASKS = "tasks AS (SELECT user_id, arg_max(c, event_id) FILTER (c IS NOT NULL) AS category, bool_and(user_id%2=0) AS state, sum(k) AS tokens FROM (SELECT *, CASE k%3 WHEN 0 THEN 'bugfix' WHEN 1 THEN 'feature' END AS c FROM " + _K + ") GROUP BY 1)"
_q("agg_pilot_categories", f"WITH {_TASKS} SELECT category, count_if(NOT state)::BIGINT AS \"off\", count_if(state)::BIGINT AS \"on\", median(tokens) FILTER (NOT state) AS median_off, median(tokens) FILTER (state) AS median_on FROM tasks GROUP BY 1", lambda s, d: activity.pilot_categories(activity.tasks(rel.turns(s, d).drop("task"))).select("category", "off", "on", "median_off", "median_on"))
# store
_q("sink_touch", duck("SELECT o.path, coalesce(n.size, o.size) AS size FROM old o LEFT JOIN new n ON n.path=o.path", "snapshots"), lambda s, d: (lambda a, b: touched(a.withColumn("mtime_ns", F.lit(0).cast("long")), b.withColumn("mtime_ns", F.lit(1).cast("long"))).select("path", "size"))(*rel.snapshots(s, d)))
_q("sink_set_resolved", duck("SELECT path, target, CASE WHEN target::BIGINT%7=0 THEN 'found/'||target WHEN target::BIGINT%7=1 THEN NULL ELSE resolved END AS resolved FROM imports", "imports"), lambda s, d: (lambda i: resolved(i, i.where("target % 7 < 2").select("path", "target", F.when(F.col("target") % 7 == 0, F.concat(F.lit("found/"), "target")).alias("resolved"))).select("path", "target", "resolved"))(rel.imports(s, d)))
_q("win_next_id", "SELECT coalesce(max(regexp_extract(t, '^T([0-9]+)$', 1)::BIGINT), 0)+1 AS next FROM (SELECT CASE WHEN o_orderkey%2=0 THEN 'T'||o_orderkey ELSE 'X'||o_orderkey*100 END AS t FROM orders) WHERE regexp_matches(t, '^T[0-9]+$')", lambda s, d: _t(s, d, "orders").select(F.regexp_extract(F.expr("CASE WHEN o_orderkey%2=0 THEN concat('T', o_orderkey) ELSE concat('X', o_orderkey*100) END"), r"^T(\d+)$", 1).try_cast("long").alias("n")).agg((F.coalesce(F.max("n"), F.lit(0)) + 1).alias("next")))
_q("limit_offset_cursor", "SELECT c_custkey, c_name FROM customer ORDER BY c_name, c_custkey LIMIT 50 OFFSET 100", lambda s, d: _t(s, d, "customer").select("c_custkey", "c_name").orderBy("c_name", "c_custkey").offset(100).limit(50))
_q("sample_shuffle", "SELECT s_suppkey, row_number() OVER (ORDER BY md5('7:'||s_suppkey)) AS place FROM supplier", lambda s, d: _t(s, d, "supplier").selectExpr("s_suppkey", "cast(row_number() over (order by md5(concat('7:', s_suppkey))) as long) as place"))
_q("pred_optional", "SELECT c_custkey FROM customer WHERE c_mktsegment='BUILDING'", lambda s, d: optional(_t(s, d, "customer"), c_mktsegment="BUILDING", c_nationkey=None).select("c_custkey"))
_q("pred_binary", "SELECT doc_id FROM documents WHERE doc_id%3=0", lambda s, d: _t(s, d, "documents").where(is_binary(F.expr("CASE WHEN doc_id%3=0 THEN concat(substr(text, 1, 10), char(0)) ELSE text END").cast("binary"))).select("doc_id"))
_q("agg_pack_pairs", "SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderpriority IN ('1-URGENT','2-HIGH') GROUP BY 1", lambda s, d: _t(s, d, "orders").groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))).alias("m")).select("o_custkey", F.size(F.map_filter("m", lambda k, v: v.isin("1-URGENT", "2-HIGH"))).cast("long").alias("n")).where("n > 0"))
_q("join_cache_left", "SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON l.doc_id=d.doc_id", lambda s, d: _t(s, d, "documents").select("doc_id").join(_t(s, d, "labels").select("doc_id", "quality"), "doc_id", "left"))


def typed(f):
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(f, na_action="ignore")

    return F.pandas_udf(run, StringType())


def _text_query(name: str, sql: str, f, text: str) -> None:
    _q(name, f"SELECT p_partkey AS k, {sql} AS t FROM part", lambda s, d: _t(s, d, "part").select(F.col("p_partkey").alias("k"), typed(f)(F.expr(text)).alias("t")))


_text_query("fn_clean_comment", "'One '||p_size||chr(10)||'two'", prose.clean_comment, "concat('/** One ', p_size, '\n *   two\n */')")
_text_query("fn_clean_docstring", "'One '||p_size||chr(10)||chr(10)||'two'", prose.clean_docstring, "concat('r\"\"\"One ', p_size, '\n\n    two\n    \"\"\"')")
_text_query("fn_readme_summary", "'It has '||p_size||' parts. And more.'", prose.readme_summary, "concat('---\nx: y\n---\n# Title\n[![b](u)](v)\n\nIt has [', p_size, ' parts](u).\nAnd more.\n\nNext')")
_text_query("fn_jsonc", "CASE WHEN p_partkey%3=0 THEN NULL ELSE '{\"a\":['||p_size||'],\"b\":\"x // y, }\"}' END", prose.relaxed_json, "CASE WHEN p_partkey % 3 = 0 THEN '{a: 1' ELSE concat('{ // c\n \"b\": \"x // y, }\", /* d */ \"a\": [', p_size, ',],}') END")
_text_query("fn_compact_list", "'a.b'||p_size||'.{x, y}'", lambda t: tx.compact_list(t.split(","), "."), "concat('a.b', p_size, '.x,a.b', p_size, '.y')")
_q("fn_doc_summary_short", "SELECT p_partkey AS k, 'Adds '||p_size||' parts' AS t FROM part", lambda s, d: _t(s, d, "part").select(F.col("p_partkey").alias("k"), tx.summary_short(F.expr("concat('Adds ', p_size, '\n parts. More.\n\nLater')")).alias("t")))
_q("fn_path_normalize", "SELECT p_partkey AS k, CASE p_partkey%3 WHEN 0 THEN 'a/c'||p_size WHEN 1 THEN '' END AS t FROM part", lambda s, d: _t(s, d, "part").select(F.col("p_partkey").alias("k"), normal_path(F.expr("CASE p_partkey % 3 WHEN 0 THEN concat('./a//b/../c', p_size, '/') WHEN 1 THEN 'a/..' ELSE '../x' END")).alias("t")))
_q("fn_stem", "SELECT p_partkey AS k, CASE p_partkey%3 WHEN 0 THEN 'a.b' WHEN 1 THEN '.env' ELSE 'run' END AS stem, CASE p_partkey%3 WHEN 0 THEN '.py' ELSE '' END AS ext FROM part", lambda s, d: _t(s, d, "part").withColumn("p", F.expr("CASE p_partkey % 3 WHEN 0 THEN 'x/a.b.py' WHEN 1 THEN '.env' ELSE 'bin/run' END")).select(F.col("p_partkey").alias("k"), tx.stem(F.col("p")).alias("stem"), tx.extension(F.col("p")).alias("ext")))
_q("fn_format_percent", "SELECT p_partkey AS k, CASE p_partkey%3 WHEN 0 THEN '+'||p_size||'.0%' WHEN 1 THEN '−'||p_size||'.0%' ELSE '–' END AS t FROM part", lambda s, d: _t(s, d, "part").select(F.col("p_partkey").alias("k"), va.signed_percent(F.expr("CASE p_partkey % 3 WHEN 0 THEN p_size / 100 WHEN 1 THEN -p_size / 100 END")).alias("t")))
_q("agg_latency_p95", duck("SELECT task, CASE WHEN n=1 THEN v[1] ELSE (v[j]*(20-d)+v[j+1]*d)/20 END AS p95 FROM (SELECT *, 19*(n+1)-20*j AS d FROM (SELECT *, least(greatest((19*(n+1))//20, 1), n-1) AS j FROM (SELECT task, list_sort(list(metric)) AS v, count(*) AS n FROM runs GROUP BY task)))", "runs"), lambda s, d: activity.exact_p95(rel.runs(s, d).select("task", F.col("metric").alias("x")), ["task"]).withColumn("p95", F.col("p95")))
_q("agg_decision", f"SELECT event_id, CASE WHEN k%7=0 THEN NULL WHEN -(k%50)/100.0 > -0.10 OR (k%17)/100.0 > 0.10 THEN 'stop' WHEN -(k%50)/100.0 <= -0.20 AND (k%17)/100.0 <= 0.05 AND NOT (k%11<>0 AND (k%9)*8 < (k%5)*9) THEN 'go' ELSE 'narrow' END AS decision FROM {_K}", lambda s, d: _parts(s, d, tokens="CASE WHEN k % 7 <> 0 THEN cast(-(k % 50) / 100 as double) END", time="cast((k % 17) / 100 as double)", on="k % 9", on_n="CASE WHEN k % 11 <> 0 THEN 9 END", off="k % 5", off_n="8").select("event_id", activity.decision_column(*map(F.col, ("tokens", "time", "on", "on_n", "off", "off_n"))).alias("decision")))
QUERIES["agg_bootstrap"] = lambda s, d: _interval(s, d)
_q("join_go_package", "SELECT 'm/a'||l_partkey%50||'/x'||l_linenumber AS target, max(CASE WHEN p%3=0 THEN 'm/a'||p ELSE 'm' END) AS module FROM (SELECT DISTINCT l_partkey, l_linenumber, l_partkey%50 AS p FROM lineitem) GROUP BY 1", lambda s, d: graph.longest_prefix(_t(s, d, "lineitem").select(F.expr("concat('m/a', l_partkey % 50, '/x', l_linenumber)").alias("target")).distinct(), s.range(50).where("id % 3 = 0").select(F.concat(F.lit("m/a"), F.col("id").cast("string")).alias("module")).union(s.range(1).select(F.lit("m").alias("module")))))
_q("join_alias_nearest", "SELECT 'w/p'||k||'/src/f'||k||'.ts' AS path, CASE WHEN k%2=0 THEN 'w/p'||k ELSE 'w' END AS dir FROM (SELECT p_partkey AS k FROM part)", lambda s, d: (lambda k: graph.nearest_config(k.select(F.expr("concat('w/p', k, '/src/f', k, '.ts')").alias("path")), k.where("k % 2 = 0").select(F.expr("concat('w/p', k)").alias("dir")).union(k.limit(1).select(F.lit("w").alias("dir")))))(_t(s, d, "part").select(F.col("p_partkey").alias("k"))))
_q("ex_import_resolution_scope", "SELECT p_partkey AS k, p_partkey%5 < 3 AS everything FROM part", lambda s, d: _t(s, d, "part").select(F.col("p_partkey").alias("k"), feeds_resolution(F.expr("CASE p_partkey % 5 WHEN 0 THEN 'x/go.mod' WHEN 1 THEN 'tsconfig.base.json' WHEN 2 THEN 'a/package.json' WHEN 3 THEN 'a/my_go.mod' ELSE 'a/x.ts' END")).alias("everything")))
_q("win_budget_fill", "SELECT p_partkey AS k, 'aaaa,cc' AS kept, 1 AS dropped FROM part", lambda s, d: _t(s, d, "part").select(F.col("p_partkey").alias("k"), classify.fill_budget(F.array(F.lit("aaaa"), F.lit("bbbbbb"), F.lit("cc")), 7).alias("f")).select("k", F.array_join("f.kept", ",").alias("kept"), "f.dropped"))
_q("sink_skipped", duck("SELECT path, size FROM new WHERE path%6<>0 UNION ALL SELECT path, size FROM old WHERE path NOT IN (SELECT path FROM new) AND path%6<>0", "snapshots"), lambda s, d: (lambda old, new: snapshot.delete(snapshot.upsert(old, new), new.union(old).where("path % 6 = 0")))(*rel.snapshots(s, d)))
_q("rd_skipped_states", duck("SELECT path, size FROM old WHERE path%100=0", "snapshots"), lambda s, d: rel.snapshots(s, d)[0].where("path % 100 = 0").select("path", "size"))
_META = "SELECT c_mktsegment AS key, count(*)::VARCHAR AS value FROM customer GROUP BY 1"
_meta = lambda s, d: _t(s, d, "customer").groupBy(F.col("c_mktsegment").alias("key")).agg(F.count("*").cast("string").alias("value"))
_q("rd_meta", f"SELECT value FROM ({_META}) WHERE key='BUILDING'", lambda s, d: _meta(s, d).where("key = 'BUILDING'").select("value"))
_q("sink_meta", f"SELECT key, CASE key WHEN 'BUILDING' THEN 'new' ELSE value END AS value FROM ({_META}) UNION ALL SELECT 'other', 'x'", lambda s, d: (lambda old, new: old.join(new.select("key"), "key", "left_anti").unionByName(new))(_meta(s, d), s.createDataFrame([("BUILDING", "new"), ("other", "x")], "key string, value string")))
_q("st_incremental_index", duck("SELECT path, size FROM new", "snapshots"), lambda s, d: _increment(*rel.snapshots(s, d)))
_q("sink_report_json", f"SELECT user_id AS session, '{{\"n\":'||count(*)||',\"session\":'||user_id||'}}' AS value FROM events GROUP BY user_id", lambda s, d: _t(s, d, "events").groupBy(F.col("user_id").alias("session")).agg(F.count("*").alias("n")).select("session", F.to_json(F.struct("n", "session")).alias("value")))
_q("st_subagent_rows", f"SELECT user_id AS session, sum(k)::BIGINT AS tokens FROM {_K} WHERE event_type='error' GROUP BY 1", lambda s, d: rel.turns(s, d).where("kind = 'subagent'").withColumn("session", F.col("session").cast("long")).groupBy("session").agg(F.sum("tokens").cast("long").alias("tokens")))


def _interval(s: SparkSession, d: str) -> DataFrame:
    """The headline with its interval: one delta per task reaches the driver."""
    m = activity.exact_medians(rel.runs(s, d).select("task", "condition", F.col("metric").alias("x")), ["task", "condition"]).groupBy("task").pivot("condition", ["A", "N"]).agg(F.first("median")).where("A is not null and N <> 0").orderBy("task")
    found = activity.bootstrap([r["A"] / r["N"] - 1 for r in m.collect()])
    return s.createDataFrame([found] if found else [], "low double, high double")


def _increment(old: DataFrame, new: DataFrame) -> DataFrame:
    """The old state brought up to the new one by what changed alone."""
    diff = snapshot.difference(old, new)
    changed = new.join(diff.where("state <> 'gone'").select("path"), "path", "left_semi")
    return snapshot.upsert(snapshot.delete(old, diff.where("state = 'gone'").select("path")), changed)


def feeds_resolution(path):
    """Whether a file's content decides how imports of other files resolve."""
    return F.rlike(path, F.lit(r"(^|/)(go\.mod|Cargo\.toml|package\.json|(ts|js)config(\..*)?\.json)$"))


def optional(rows: DataFrame, **wanted) -> DataFrame:
    """The rows that equal every value given; None asks for nothing."""
    for name, value in wanted.items():
        rows = rows if value is None else rows.where(F.col(name) == value)
    return rows


def is_binary(content, sniff: int = 8192):
    """Whether a zero byte stands near the start."""
    return F.locate("00", F.regexp_replace(F.hex(F.substring(content, 1, sniff)), "(..)", "$1 ")) > 0


def _report(s: SparkSession, d: str) -> DataFrame:
    """The pilot report as rows: how many tasks on either side, medians of metrics, medians by category."""
    t = activity.task_metrics(activity.tasks(rel.turns(s, d).drop("task")))
    columns = ("part", "name", "off", "on")
    as_double = lambda c: F.col(c).cast("double").alias(c)
    counts = activity.pilot_overview(t).select(F.lit("tasks").alias("part"), F.col("tasks").cast("string").alias("name"), as_double("off"), as_double("on"))
    medians = activity.pilot(t, ["tokens", "prompts", "answers", "corrections"]).select(F.lit("median").alias("part"), F.col("metric").alias("name"), "off", "on")
    groups = activity.pilot_categories(t).select(F.lit("category").alias("part"), F.coalesce("category", F.lit("-")).alias("name"), F.col("median_off").alias("off"), F.col("median_on").alias("on"))
    return counts.select(*columns).unionByName(medians.select(*columns)).unionByName(groups.select(*columns))


_MORE = "rows AS (SELECT user_id, sum(k) AS tokens, sum(k%4) AS prompts, count_if(event_type='view') AS asked, bool_and(user_id%2=0) AS state, arg_max(c, event_id) FILTER (c IS NOT NULL) AS category FROM (SELECT *, CASE k%3 WHEN 0 THEN 'bugfix' WHEN 1 THEN 'feature' END AS c FROM " + _K + ") GROUP BY 1), t AS (SELECT *, least(asked, greatest(0, prompts-1)) AS answers, greatest(0, prompts-1)-least(asked, greatest(0, prompts-1)) AS corrections FROM rows)"
_SIDES = "median({0}) FILTER (NOT state)::DOUBLE AS \"off\", median({0}) FILTER (state)::DOUBLE AS \"on\" FROM t"
_q("report", f"WITH {_MORE} SELECT 'tasks' AS part, count(*)::VARCHAR AS name, count_if(NOT state)::DOUBLE AS \"off\", count_if(state)::DOUBLE AS \"on\" FROM t" + "".join(f" UNION ALL SELECT 'median', '{m}', {_SIDES.format(m)}" for m in ("tokens", "prompts", "answers", "corrections")) + f" UNION ALL SELECT 'category', coalesce(category, '-'), {_SIDES.format('tokens')} GROUP BY category", _report)
