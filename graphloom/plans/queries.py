"""One query per operator over whole tables, each with its DuckDB counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import values as va
from ..functions.globs import globs_regex
from ..operators import activity, graph, search, snapshot
from . import relations as rel
from .relations import duck

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name], ORACLES[name] = f, oracle
        return f

    return add


def _q(name: str, oracle: str, f: Callable[[SparkSession, str], DataFrame]) -> None:
    QUERIES[name], ORACLES[name] = f, oracle


_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_NAME, _DOC = _FOLD.format("name"), _FOLD.format("s.doc")
S, D = SparkSession, str

# scans and reads
_q("scan_text_lines", duck("SELECT path, line, length(line_text) AS n FROM lines", "lines"), lambda s, d: rel.lines(s, d).select("path", "line", F.length("line_text").cast("long").alias("n")))
_q("scan_enumerate", duck("SELECT path, lang, size, hash FROM files", "files"), lambda s, d: rel.files(s, d).select("path", "lang", "size", "hash"))
_q("scan_gate_log", "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS outcome, count(*) AS n FROM events GROUP BY 1, 2", lambda s, d: rel.table(s, d, "events").select(va.epoch_to_day(F.unix_seconds(F.col("ts").cast("timestamp"))).alias("day"), F.col("event_type").alias("outcome")).groupBy("day", "outcome").agg(F.count("*").alias("n")))
_q("scan_git_grep", duck("SELECT path, line FROM lines WHERE contains(line_text, 'worthless')", "lines"), lambda s, d: rel.lines(s, d).where(F.contains("line_text", F.lit("worthless"))).select("path", "line"))
_q("scan_git_numstat", duck("SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'A' WHEN n.path IS NULL THEN 'D' ELSE 'M' END AS status, greatest(coalesce(n.size,0)-coalesce(o.size,0),0) AS added, greatest(coalesce(o.size,0)-coalesce(n.size,0),0) AS deleted FROM old o FULL JOIN new n ON o.path=n.path WHERE o.size IS DISTINCT FROM n.size", "snapshots"), lambda s, d: _numstat(*rel.snapshots(s, d)))


def _numstat(old: DataFrame, new: DataFrame) -> DataFrame:
    o, n = old.withColumnRenamed("size", "was").withColumn("o", F.lit(1)), new.withColumnRenamed("size", "now").withColumn("n", F.lit(1))
    was, now = F.coalesce("was", F.lit(0)), F.coalesce("now", F.lit(0))
    j = o.join(n, "path", "full_outer").where(~F.col("was").eqNullSafe(F.col("now")))
    return j.select("path", F.when(F.col("o").isNull(), "A").when(F.col("n").isNull(), "D").otherwise("M").alias("status"), F.greatest(now - was, F.lit(0)).alias("added"), F.greatest(was - now, F.lit(0)).alias("deleted"))


# predicates and projections
_q("pred_subtree", duck("SELECT path FROM files WHERE path='src3/de' OR starts_with(path, 'src3/de/')", "files"), lambda s, d: rel.files(s, d).where(tx.subtree(F.col("path"), "src3/de")).select("path"))
_q("pred_like_escape", duck("SELECT path, line FROM lines WHERE contains(line_text, '%') AND contains(line_text, '&')", "lines"), lambda s, d: rel.lines(s, d).where(F.contains("line_text", F.lit("%")) & F.contains("line_text", F.lit("&"))).select("path", "line"))
_q("pred_parent", duck(f"SELECT path, name, start_line FROM symbols WHERE name='That' OR {_NAME} LIKE '%.the'", "symbols"), lambda s, d: rel.symbols(s, d).where((F.col("name") == "That") | F.endswith(tx.fold(F.col("name")), F.lit(".the"))).select("path", "name", "start_line"))
_q("pred_nullsafe_eq", duck("SELECT path, target FROM imports WHERE resolved IS NOT DISTINCT FROM NULL", "imports"), lambda s, d: rel.imports(s, d).where(F.col("resolved").eqNullSafe(F.lit(None).cast("string"))).select("path", "target"))
_q("pred_between_cols", duck("SELECT r.path, r.line, s.start_line FROM refs r JOIN symbols s ON r.path=s.path AND r.line BETWEEN s.start_line AND s.end_line", "refs", "symbols"), lambda s, d: rel.refs(s, d).join(rel.symbols(s, d).select(F.col("path").alias("p"), "start_line", "end_line"), (F.col("path") == F.col("p")) & F.col("line").between(F.col("start_line"), F.col("end_line"))).select("path", "line", "start_line"))
_q("pred_nocase", duck(f"SELECT path, name, start_line FROM symbols WHERE {_NAME}='the' AND (name='the' OR NOT EXISTS (SELECT 1 FROM symbols WHERE name='the'))", "symbols"), lambda s, d: search.exact_symbols(rel.symbols(s, d), "the").select("path", "name", "start_line"))
_q("pred_glob", duck("SELECT path FROM files WHERE regexp_full_match(path, 'src1[0-9]/(.*/)?doc_[^/]*\\.txt') AND lang IN ('de','fr')", "files"), lambda s, d: rel.files(s, d).where(F.rlike("path", F.lit(globs_regex(["src1[0-9]/**/doc_*.txt"]))) & F.col("lang").isin("de", "fr")).select("path"))
_q("pred_since", duck("SELECT seq, \"at\" FROM turns WHERE \"at\"[1:10] >= '2024-01-15'", "turns"), lambda s, d: rel.turns(s, d).where(va.since(F.col("at"), "2024-01-15")).select("seq", "at"))
_q("proj_symbol_hit", duck("SELECT s.path, s.name, s.kind, s.start_line, s.end_line, f.is_test FROM symbols s JOIN files f ON s.path=f.path", "symbols", "files"), lambda s, d: rel.symbols(s, d).join(rel.files(s, d).select("path", "is_test"), "path").select("path", "name", "kind", "start_line", "end_line", "is_test"))

# store reads
_q("rd_import_rows", duck("SELECT path, target, resolved FROM imports", "imports"), lambda s, d: rel.imports(s, d))
_q("rd_langs", duck("SELECT path, lang FROM files", "files"), lambda s, d: rel.files(s, d).select("path", "lang"))
_q("rd_dirs", duck("SELECT DISTINCT dir FROM files", "files"), lambda s, d: rel.files(s, d).select("dir").distinct())
_q("rd_dir_files", duck("SELECT path FROM files WHERE dir='src2/en'", "files"), lambda s, d: rel.files(s, d).where("dir = 'src2/en'").select("path"))
_q("rd_dir_symbols", duck("SELECT s.path, s.name, s.start_line FROM symbols s JOIN files f ON s.path=f.path WHERE f.dir='src2/en'", "symbols", "files"), lambda s, d: rel.symbols(s, d).join(rel.files(s, d).where("dir = 'src2/en'").select("path"), "path", "left_semi").select("path", "name", "start_line"))
_q("rd_paths_named", duck("SELECT path FROM files WHERE path='doc_7.txt' OR ends_with(path, '/doc_7.txt') ORDER BY length(path), path LIMIT 10", "files"), lambda s, d: search.shortest_first(rel.files(s, d).where((F.col("path") == "doc_7.txt") | F.endswith("path", F.lit("/doc_7.txt"))).select("path"), "path"))
_q("rd_has_dir", duck("SELECT count(*) > 0 AS found FROM files WHERE starts_with(path, 'src5/')", "files"), lambda s, d: rel.files(s, d).where(tx.subtree(F.col("path"), "src5")).limit(1).agg((F.count("*") > 0).alias("found")))
_q("rd_source_files_under", duck("SELECT path FROM files WHERE NOT is_test AND lang IS NOT NULL AND starts_with(path, 'src5/')", "files"), lambda s, d: rel.files(s, d).where(~F.col("is_test") & F.col("lang").isNotNull() & tx.subtree(F.col("path"), "src5")).select("path"))
_q("rd_sources_with_stem", duck("SELECT path FROM files WHERE NOT is_test AND regexp_extract(path, '([^/]*)\\.txt$', 1)='doc_42'", "files"), lambda s, d: rel.files(s, d).where(~F.col("is_test") & (tx.stem(F.col("path")) == "doc_42")).select("path"))
_q("rd_dirs_like", duck("SELECT DISTINCT dir FROM files WHERE contains(dir, '1/')", "files"), lambda s, d: rel.files(s, d).where(F.contains("dir", F.lit("1/"))).select("dir").distinct())
_q("rd_refs_named", duck("SELECT path, line FROM refs WHERE name='of' ORDER BY path, line LIMIT 500", "lines", "refs"), lambda s, d: rel.refs(s, d).where("name = 'of'").select("path", "line").orderBy("path", "line").limit(500))
_q("rd_symbol_names", duck("SELECT DISTINCT name FROM symbols", "symbols"), lambda s, d: rel.symbols(s, d).select("name").distinct())
_q("rd_test_files", duck("SELECT path FROM files WHERE is_test AND lang IS NOT NULL", "files"), lambda s, d: rel.files(s, d).where("is_test and lang is not null").select("path"))
_q("rd_undocumented", duck("SELECT s.path, s.name, s.start_line FROM symbols s JOIN files f ON s.path=f.path WHERE s.doc IS NULL AND s.kind IN ('class','function')", "symbols", "files"), lambda s, d: rel.symbols(s, d).where("doc is null and kind in ('class', 'function')").join(rel.files(s, d).select("path"), "path").select("path", "name", "start_line"))
_q("rd_name_block", duck("SELECT DISTINCT name FROM symbols WHERE name[1:2]='Th' ORDER BY name LIMIT 2000", "symbols"), lambda s, d: rel.symbols(s, d).where(F.substring("name", 1, 2) == "Th").select("name").distinct().orderBy("name").limit(2000))

# search
_q("topk_find_symbol", duck(f"SELECT tier::INT AS tier, name, path, start_line FROM (SELECT CASE WHEN name='the' THEN 0 WHEN {_NAME}='the' THEN 1 WHEN starts_with({_NAME},'the') THEN 2 WHEN contains({_NAME},'the') THEN 3 WHEN contains({_DOC},'the') THEN 4 END AS tier, s.name, s.path, s.start_line, s.id, f.is_test FROM symbols s JOIN files f ON s.path=f.path) WHERE tier IS NOT NULL ORDER BY tier, is_test, length(name), path, start_line, id LIMIT 50", "symbols", "files"), lambda s, d: search.find_symbol(rel.with_ids(rel.symbols(s, d)), rel.files(s, d), "the").select("tier", "name", "path", "start_line"))
_q("join_interval_enclosing", duck("SELECT path, name, line, symbol, start_line FROM (SELECT r.path, r.name, r.line, s.name AS symbol, s.start_line, row_number() OVER (PARTITION BY r.path, r.name, r.line ORDER BY s.end_line-s.start_line, s.start_line DESC, s.id DESC) AS k FROM refs r LEFT JOIN symbols s ON r.path=s.path AND r.line BETWEEN s.start_line AND s.end_line) WHERE k=1", "refs", "symbols"), lambda s, d: search.enclosing(rel.refs(s, d), rel.with_ids(rel.symbols(s, d))))
_q("semi_interval", duck("SELECT path, name, line FROM refs r WHERE EXISTS (SELECT 1 FROM symbols s WHERE s.kind='class' AND s.path=r.path AND r.line BETWEEN s.start_line AND s.end_line)", "refs", "symbols"), lambda s, d: search.calls_inside(rel.refs(s, d), rel.symbols(s, d), "class"))
_q("win_span_merge", duck("SELECT path, min(a) AS start_line, max(b) AS end_line FROM (SELECT *, sum(CASE WHEN a > reach+1 THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY a, b) AS g FROM (SELECT path, start_line AS a, end_line AS b, max(end_line) OVER (PARTITION BY path ORDER BY start_line, end_line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM symbols WHERE kind<>'constant')) GROUP BY path, g", "symbols"), lambda s, d: search.merged_spans(rel.symbols(s, d).where("kind <> 'constant'")))
_q("win_comment_block", duck("SELECT path, min(line) AS first_line, max(line) AS last_line FROM (SELECT path, line, line-row_number() OVER (PARTITION BY path ORDER BY line) AS g FROM lines WHERE length(line_text)%2=0) GROUP BY path, g", "lines"), lambda s, d: search.islands(rel.lines(s, d), F.length("line_text") % 2 == 0))
_q("win_line_shift", duck("SELECT path, line, line-coalesce(g,0)::BIGINT AS new_line FROM (SELECT path, line, gone, sum(gone) OVER (PARTITION BY path ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS g FROM (SELECT path, line, CASE WHEN length(line_text)%3=0 THEN 1 ELSE 0 END AS gone FROM lines)) WHERE gone=0", "lines"), lambda s, d: search.shifted_lines(rel.lines(s, d), rel.lines(s, d).where(F.length("line_text") % 3 == 0)).select("path", "line", F.col("new_line").cast("long").alias("new_line")))
_q("sort_shortest_first", duck("SELECT DISTINCT dir FROM files ORDER BY length(dir), dir LIMIT 10", "files"), lambda s, d: search.shortest_first(rel.files(s, d).select("dir").distinct(), "dir"))
_q("limit_callers", duck("SELECT path, line, total FROM (SELECT path, line, count(*) OVER () AS total FROM refs WHERE name='the') ORDER BY path, line LIMIT 500", "refs"), lambda s, d: (lambda r: r.join(F.broadcast(r.agg(F.count("*").alias("total")))).orderBy("path", "line").limit(500).select("path", "line", "total"))(rel.refs(s, d).where("name = 'the'").select("path", "line")))

# graph
_q("join_prefix", duck("SELECT DISTINCT path, target FROM imports WHERE resolved='Brand#11' OR starts_with(resolved, 'Brand#11/')", "imports"), lambda s, d: graph.importers_under(rel.imports(s, d), "Brand#11"))
_q("anti_inside", duck("SELECT path, target, resolved FROM imports WHERE NOT (path='order/1' OR starts_with(path, 'order/1/'))", "imports"), lambda s, d: graph.anti_inside(rel.imports(s, d), "order/1"))
_q("join_left_agg", duck("SELECT dir, count(*) AS files, coalesce(sum(n),0)::BIGINT AS symbols FROM files f LEFT JOIN (SELECT path, count(*) AS n FROM symbols GROUP BY path) s ON f.path=s.path GROUP BY dir", "files", "symbols"), lambda s, d: graph.directory_stats(rel.files(s, d), rel.symbols(s, d)))
_q("join_purpose", duck("SELECT dir, arg_min(doc, (size%3, path)) AS doc FROM files WHERE doc IS NOT NULL GROUP BY dir", "files"), lambda s, d: graph.purposes(rel.files(s, d).withColumn("rank", F.col("size") % 3)))
_q("agg_group_collect", duck("SELECT path, array_to_string(list_sort(list(DISTINCT target)), ',') AS targets FROM imports GROUP BY path", "imports"), lambda s, d: graph.targets_by_importer(rel.imports(s, d)).select("path", F.array_join("targets", ",").alias("targets")))
_q("join_symbols_files", duck("SELECT f.lang, count(*) AS n FROM symbols s JOIN files f ON s.path=f.path GROUP BY 1", "symbols", "files"), lambda s, d: rel.symbols(s, d).join(rel.files(s, d).select("path", "lang"), "path").groupBy("lang").agg(F.count("*").alias("n")))
_q("join_refs_files", duck("SELECT r.path, r.name, r.line FROM refs r JOIN files f ON r.path=f.path WHERE f.is_test", "refs", "files"), lambda s, d: rel.refs(s, d).join(rel.files(s, d).where("is_test").select("path"), "path", "left_semi"))
_q("join_test_same_package", duck("SELECT t.path AS test, t.dir, count(*) AS sources FROM files t JOIN files s ON t.dir=s.dir AND t.path<>s.path WHERE t.is_test GROUP BY 1, 2", "files"), lambda s, d: graph.tests_in_package_counts(rel.files(s, d)))
_q("sort_path_components", duck("SELECT dir, row_number() OVER (ORDER BY string_split(dir,'/')) AS place FROM (SELECT DISTINCT dir FROM files)", "files"), lambda s, d: rel.files(s, d).select("dir").distinct().selectExpr("dir", "cast(row_number() over (order by split(dir, '/')) as long) as place"))

# aggregates
_q("agg_counts", duck("SELECT (SELECT count(*) FROM files) AS files, (SELECT count(*) FROM symbols) AS symbols, (SELECT count(*) FROM refs) AS refs", "files", "symbols", "refs"), lambda s, d: rel.files(s, d).agg(F.count("*").alias("files")).crossJoin(rel.symbols(s, d).agg(F.count("*").alias("symbols"))).crossJoin(rel.refs(s, d).agg(F.count("*").alias("refs"))))
_q("agg_ref_count", duck("SELECT name, count(*) AS n FROM refs GROUP BY name", "lines", "refs"), lambda s, d: rel.refs(s, d).groupBy("name").agg(F.count("*").alias("n")))
_q("agg_distinct", duck("SELECT DISTINCT name FROM refs", "lines", "refs"), lambda s, d: rel.refs(s, d).select("name").distinct())
_q("agg_lang_counts", duck("SELECT lang, count(*) AS n FROM files GROUP BY lang", "files"), lambda s, d: rel.files(s, d).groupBy("lang").agg(F.count("*").alias("n")))
_q("win_active_time", duck("SELECT session, sum(s)::BIGINT AS active_s FROM (SELECT session, seg, max(\"at\")-min(opened) AS s FROM (SELECT *, min(start_at) OVER (PARTITION BY session, seg) AS opened FROM (SELECT *, CASE WHEN is_prompt OR (seg=0 AND opens AND NOT ignored) THEN \"at\" END AS start_at FROM (SELECT *, sum(is_prompt::INT) OVER (PARTITION BY session ORDER BY \"at\", ord) AS seg FROM stream))) WHERE (NOT ignored OR is_prompt) AND \"at\" >= opened GROUP BY session, seg) GROUP BY session", "stream"), lambda s, d: activity.active_time(rel.stream(s, d)))
_TASKS = "tasks AS (SELECT CASE WHEN coalesce(task,'') <> '' THEN ':'||task ELSE ':session:'||session END AS key, sum(tokens)::BIGINT AS tokens, sum(prompts)::BIGINT AS prompts, count_if(asked AND kind='turn')::BIGINT AS asked, coalesce(sum(active_s) FILTER (kind='turn'), 0) AS active_s, arg_max(category, seq) FILTER (category <> '') AS category, min(\"at\") AS first_at, max(\"at\") AS last_at, CASE WHEN count(DISTINCT assisted)=1 THEN bool_and(assisted) END AS state FROM turns GROUP BY 1)"
_q("agg_tasks_rollup", "WITH " + rel.DUCK["turns"] + ", " + _TASKS + " SELECT key, tokens, prompts, asked, round(active_s, 4) AS active_s, category, first_at, last_at, state FROM tasks", lambda s, d: activity.tasks(rel.turns(s, d)).drop("size").withColumn("active_s", F.round("active_s", 4)))
_q("agg_task_metrics", "WITH " + rel.DUCK["turns"] + ", " + _TASKS + " SELECT key, least(asked, greatest(0, prompts-1)) AS answers, greatest(0, prompts-1)-least(asked, greatest(0, prompts-1)) AS corrections FROM tasks", lambda s, d: activity.task_metrics(activity.tasks(rel.turns(s, d))).select("key", "answers", "corrections"))
_PILOT = "SELECT '{0}' AS metric, median({0}) FILTER (NOT state) AS off, median({0}) FILTER (state) AS \"on\" FROM t"
_q("agg_pilot", "WITH " + rel.DUCK["turns"] + ", t AS (SELECT session AS key, sum(tokens)::DOUBLE AS tokens, sum(prompts)::DOUBLE AS prompts, bool_and(assisted) AS state FROM turns WHERE task IS NULL GROUP BY 1), p AS (" + _PILOT.format("tokens") + " UNION ALL " + _PILOT.format("prompts") + ") SELECT metric, off, \"on\", round(CASE WHEN off <> 0 THEN (\"on\"-off)/off END, 9) AS change FROM p", lambda s, d: activity.pilot(activity.tasks(rel.turns(s, d).where("task is null")), ["tokens", "prompts"]).withColumn("change", F.round("change", 9)))
_GATE = "CASE event_type WHEN 'click' THEN 'ask' WHEN 'error' THEN 'block' WHEN 'signup' THEN 'bypass' ELSE event_type END"
_q("agg_gate_summary", f"SELECT count(*) AS total, asked, bypassed, round(bypassed/count(*), 9) AS bypass_rate FROM (SELECT *, count_if(o IN ('ask','warn','block')) OVER ()::BIGINT AS asked, count_if(o='bypass') OVER ()::BIGINT AS bypassed FROM (SELECT {_GATE} AS o FROM events)) GROUP BY asked, bypassed", lambda s, d: activity.gate_summary(rel.table(s, d, "events").select(F.expr(_GATE).alias("outcome"))).withColumn("bypass_rate", F.round("bypass_rate", 9)))
_q("agg_headline", duck("SELECT round(median(d), 9) AS delta, count(*) AS n FROM (SELECT (a-b)/b AS d FROM (SELECT task, median(metric) FILTER (condition='A') AS a, median(metric) FILTER (condition='N') AS b FROM runs GROUP BY task) WHERE a IS NOT NULL AND b IS NOT NULL AND b <> 0)", "runs"), lambda s, d: activity.headline(rel.runs(s, d), "A", "N").withColumn("delta", F.round("delta", 9)))
_q("agg_passes", duck("SELECT condition, count_if(passed)::BIGINT AS passed, count(*) AS total FROM runs GROUP BY 1", "runs"), lambda s, d: activity.passes(rel.runs(s, d)))
_q("agg_median", duck("SELECT task, median(metric) AS m FROM runs GROUP BY task", "runs"), lambda s, d: rel.runs(s, d).groupBy("task").agg(F.median("metric").alias("m")))
_q("agg_map_merge", duck("SELECT session, tool, sum(tokens)::BIGINT AS v FROM turns GROUP BY 1, 2", "turns"), lambda s, d: activity.merged_maps(rel.turns(s, d).select("session", F.create_map("tool", "tokens").alias("m")), "session", "m").select("session", F.explode("m").alias("tool", "v")))
_q("agg_usage_by_model", duck("SELECT kind, tool, sum(tokens)::BIGINT AS tokens FROM turns GROUP BY 1, 2", "turns"), lambda s, d: rel.turns(s, d).groupBy("kind", "tool").agg(F.sum("tokens").cast("long").alias("tokens")))

# snapshots and sets
_q("set_snapshot_diff", duck("SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'new' WHEN n.path IS NULL THEN 'gone' ELSE 'changed' END AS state FROM old o FULL JOIN new n ON o.path=n.path WHERE o.size IS DISTINCT FROM n.size", "snapshots"), lambda s, d: snapshot.difference(*rel.snapshots(s, d)))
_q("sink_put_file", duck("SELECT path, size FROM old WHERE path NOT IN (SELECT path FROM new) UNION ALL SELECT path, size FROM new", "snapshots"), lambda s, d: snapshot.upsert(*rel.snapshots(s, d)))
_q("sink_delete_files", duck("SELECT path, size FROM old WHERE path NOT IN (SELECT path FROM new)", "snapshots"), lambda s, d: snapshot.delete(*rel.snapshots(s, d)))
_q("sink_summaries", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id", lambda s, d: snapshot.latest(rel.table(s, d, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_type"))
_q("sink_generated_docs", duck("SELECT path, name, start_line, coalesce(doc, 'about '||name) AS doc FROM symbols", "symbols"), lambda s, d: snapshot.fill_missing(rel.symbols(s, d), rel.symbols(s, d).where("doc is null").select("path", "start_line", F.concat(F.lit("about "), F.col("name")).alias("doc")), ["path", "start_line"], "doc").select("path", "name", "start_line", "doc"))
_q("win_keep_newest", duck("SELECT path, size FROM old ORDER BY size DESC, path LIMIT 200", "snapshots"), lambda s, d: snapshot.newest(rel.snapshots(s, d)[0], "size", 200, "path"))
_q("set_union_dedup", duck("SELECT path FROM old UNION SELECT path FROM new", "snapshots"), lambda s, d: (lambda a, b: a.select("path").union(b.select("path")).distinct())(*rel.snapshots(s, d)))
_q("set_difference", duck("SELECT path FROM new EXCEPT SELECT path FROM old", "snapshots"), lambda s, d: (lambda a, b: b.select("path").join(a.select("path"), "path", "left_anti"))(*rel.snapshots(s, d)))
_q("set_ordered_unique", duck("SELECT name, min(line) AS first_line FROM refs GROUP BY name", "lines", "refs"), lambda s, d: rel.refs(s, d).groupBy("name").agg(F.min("line").alias("first_line")))

# functions over whole columns
_q("fn_estimate_tokens", duck("SELECT path, line, ((length(line_text)+2)//3)::BIGINT AS tokens FROM lines", "lines"), lambda s, d: rel.lines(s, d).select("path", "line", tx.estimate_tokens(F.col("line_text")).alias("tokens")))
_q("fn_basename", duck("SELECT path, regexp_extract(path, '[^/]*$') AS base, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir FROM files", "files"), lambda s, d: rel.files(s, d).select("path", tx.basename(F.col("path")).alias("base"), tx.dirname(F.col("path")).alias("dir")))
_q("fn_truncate_ellipsis", duck("SELECT path, line, CASE WHEN length(line_text)>40 THEN left(line_text,39)||'…' ELSE line_text END AS t FROM lines", "lines"), lambda s, d: rel.lines(s, d).select("path", "line", tx.truncate(F.col("line_text"), 40).alias("t")))
_q("fn_rel_change", duck("SELECT o.path, CASE WHEN o.size <> 0 THEN round((n.size-o.size)/o.size, 9) END AS change FROM old o JOIN new n ON o.path=n.path", "snapshots"), lambda s, d: (lambda a, b: a.join(b.withColumnRenamed("size", "now"), "path").select("path", F.round(va.rel_change(F.col("size"), F.col("now")), 9).alias("change")))(*rel.snapshots(s, d)))


def explainable(name: str, spark: SparkSession, sf_dir: str) -> str:
    """The formatted plan of a query."""
    return QUERIES[name](spark, sf_dir)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


from . import aliases, code, disk, packs, rules, stacks  # noqa: E402

QUERIES |= code.QUERIES | rules.QUERIES | disk.QUERIES | stacks.QUERIES | packs.QUERIES | aliases.QUERIES
ORACLES |= code.ORACLES | rules.ORACLES | disk.ORACLES | stacks.ORACLES | packs.ORACLES | aliases.ORACLES
# Pairs of every test with every file of its folder, without SQL.
QUERIES["join_test_same_package_whole"] = lambda s, d: graph.tests_in_package(rel.files(s, d))
