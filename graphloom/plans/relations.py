"""Relations of a source tree and of activity logs, bound to the driver's tables: once for Spark, once for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("class", "function", "method", "constant")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    path = F.concat("source", F.lit("/"), "lang", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return d.select(path.alias("path"), F.concat("source", F.lit("/"), "lang").alias("dir"), "lang", F.md5("text").alias("hash"), F.col("n_chars").alias("size"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("doc"), F.col("source").isin("src0", "src1").alias("is_test"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every file, split on \\n alone, one \\r at the end dropped, no line after the last \\n."""
    d = table(spark, sf_dir, "documents")
    path = F.concat("source", F.lit("/"), "lang", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    text = F.regexp_replace("text", r"\n\z", "")
    return d.select(path.alias("path"), F.posexplode(F.split(text, "\n")).alias("i", "line_text")).select("path", (F.col("i") + 1).cast("long").alias("line"), F.regexp_replace("line_text", r"\r\z", "").alias("line_text"))


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first word of each line names a symbol that reaches up to four lines further."""
    n = F.length("line_text")
    kind = F.get(F.array(*[F.lit(k) for k in KINDS]), (n % 4).cast("int"))
    return lines(spark, sf_dir).where("line_text <> ''").select("path", F.split_part("line_text", F.lit(" "), F.lit(1)).alias("name"), kind.alias("kind"), F.col("line").alias("start_line"), (F.col("line") + n % 5).alias("end_line"), F.when(n % 3 == 0, F.col("line_text")).alias("doc"))


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second word of each line is a call."""
    return lines(spark, sf_dir).select("path", F.split_part("line_text", F.lit(" "), F.lit(2)).alias("name"), "line").where("name <> ''")


def imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from an order to its parts; every seventh part stays unresolved."""
    li, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    resolved = F.when(F.col("l_partkey") % 7 != 0, F.concat("p_brand", F.lit("/"), F.col("l_partkey").cast("string")))
    return li.join(p, F.col("l_partkey") == F.col("p_partkey")).select(F.concat(F.lit("order/"), F.col("l_orderkey").cast("string")).alias("path"), F.col("l_partkey").cast("string").alias("target"), resolved.alias("resolved")).distinct()


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telemetry rows: an event is a turn or a subagent's row; tasks, tokens and times come from its columns."""
    k = F.get_json_object("props", "$.k").cast("long")
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("seq"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), F.col("user_id").cast("string").alias("session"), F.when(k % 5 != 0, F.concat(F.lit("t"), (k % 40).cast("string"))).alias("task"),
        F.when(F.col("event_type") == "error", "subagent").otherwise("turn").alias("kind"), F.when(k % 3 == 0, "bugfix").when(k % 3 == 1, "feature").alias("category"),
        (F.col("user_id") % 2 == 0).alias("assisted"), k.alias("tokens"), (k % 4).alias("prompts"), F.col("value").alias("active_s"), F.col("event_type").alias("tool"), (F.col("event_type") == "view").alias("asked"),
    )


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines of sessions in order: seconds, whether a human prompt, whether a line that counts for nothing."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").alias("ord"), (F.col("event_type") == "signup").alias("is_prompt"), (F.col("event_type") == "error").alias("ignored"), (F.col("event_type").isin("click", "purchase")).alias("opens"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark runs: task, condition, metric, passed."""
    li, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    return li.join(p, F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_brand").alias("task"), F.col("l_returnflag").alias("condition"), F.col("l_extendedprice").alias("metric"), (F.col("l_linestatus") == "F").alias("passed"))


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A known and a listed state of the same keys: some gone, some new, some changed."""
    o = table(spark, sf_dir, "orders")
    old = o.where("o_orderkey % 10 <> 3").select(F.col("o_orderkey").alias("path"), F.floor("o_totalprice").cast("long").alias("size"))
    new = o.where("o_orderkey % 10 <> 7").select(F.col("o_orderkey").alias("path"), (F.floor("o_totalprice").cast("long") + F.when(F.col("o_orderkey") % 4 == 0, 1).otherwise(0)).alias("size"))
    return old, new


def with_ids(symbols: DataFrame) -> DataFrame:
    """Symbol ids that order the symbols of a file: here a file has one symbol a line, so its line is its id."""
    return symbols.withColumn("id", F.col("start_line"))


#: The same relations as common table expressions of DuckDB.
DUCK = {
    "files": "files AS (SELECT source||'/'||lang||'/doc_'||doc_id||'.txt' AS path, source||'/'||lang AS dir, lang, md5(text) AS hash, n_chars AS size, split_part(text, chr(10), 1) AS doc, source IN ('src0','src1') AS is_test FROM documents)",
    "lines": "raw_lines AS (SELECT source||'/'||lang||'/doc_'||doc_id||'.txt' AS path, string_split(regexp_replace(text, '\\n\\z', ''), chr(10)) AS l FROM documents), lines AS (SELECT path, i AS line, regexp_replace(line_text, '\\r\\z', '') AS line_text FROM (SELECT path, unnest(l) AS line_text, generate_subscripts(l, 1) AS i FROM raw_lines))",
    "symbols": "symbols AS (SELECT path, split_part(line_text, ' ', 1) AS name, ['class','function','method','constant'][(length(line_text)%4+1)::INT] AS kind, line AS start_line, line + length(line_text)%5 AS end_line, CASE WHEN length(line_text)%3=0 THEN line_text END AS doc, row_number() OVER (PARTITION BY path ORDER BY line) AS id FROM lines WHERE line_text <> '')",
    "refs": "refs AS (SELECT path, split_part(line_text, ' ', 2) AS name, line FROM lines WHERE split_part(line_text, ' ', 2) <> '')",
    "imports": "imports AS (SELECT DISTINCT 'order/'||l_orderkey AS path, l_partkey::VARCHAR AS target, CASE WHEN l_partkey%7 <> 0 THEN p_brand||'/'||l_partkey END AS resolved FROM lineitem JOIN part ON l_partkey=p_partkey)",
    "turns": "turns AS (SELECT event_id AS seq, strftime(ts, '%Y-%m-%d %H:%M:%S') AS \"at\", user_id::VARCHAR AS session, CASE WHEN k%5 <> 0 THEN 't'||(k%40) END AS task, CASE WHEN event_type='error' THEN 'subagent' ELSE 'turn' END AS kind, CASE k%3 WHEN 0 THEN 'bugfix' WHEN 1 THEN 'feature' END AS category, user_id%2=0 AS assisted, k AS tokens, k%4 AS prompts, value AS active_s, event_type AS tool, event_type='view' AS asked FROM (SELECT *, json_extract_string(props,'$.k')::BIGINT AS k FROM events))",
    "stream": "stream AS (SELECT user_id AS session, floor(epoch(ts))::BIGINT AS \"at\", event_id AS ord, event_type='signup' AS is_prompt, event_type='error' AS ignored, event_type IN ('click','purchase') AS opens FROM events)",
    "runs": "runs AS (SELECT p_brand AS task, l_returnflag AS condition, l_extendedprice AS metric, l_linestatus='F' AS passed FROM lineitem JOIN part ON l_partkey=p_partkey)",
    "snapshots": "old AS (SELECT o_orderkey AS path, floor(o_totalprice)::BIGINT AS size FROM orders WHERE o_orderkey%10 <> 3), new AS (SELECT o_orderkey AS path, floor(o_totalprice)::BIGINT + CASE WHEN o_orderkey%4=0 THEN 1 ELSE 0 END AS size FROM orders WHERE o_orderkey%10 <> 7)",
}
_NEEDS = {"symbols": ("lines",), "refs": ("lines",)}


def duck(query: str, *relations: str) -> str:
    """A DuckDB query over the named relations."""
    wanted: list[str] = []
    for r in relations:
        for x in (*_NEEDS.get(r, ()), r):
            if x not in wanted:
                wanted.append(x)
    return "WITH " + ", ".join(DUCK[r] for r in wanted) + " " + query
