"""Queries of sources and sinks that read and write files: small trees and logs made of the driver's tables, in the shared folder."""

from __future__ import annotations

import json
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import classify, tools
from ..sources import files as fs
from ..sources import logs
from ..sources.store import Store, append_rows, write_changed
from . import code, rules
from .relations import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that all executors share; without one, on a local master, below the system's."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.gettempdir()
    path = f"{base.removeprefix('file://').rstrip('/')}/graphloom-{uuid.uuid4().hex}/{name}"
    os.makedirs(path, exist_ok=True)
    return path


def _q(name: str, sql: str, f) -> None:
    QUERIES[name] = f
    if sql:
        ORACLES[name] = sql


def _tree(s: SparkSession, d: str) -> str:
    """A file for each nation: some hidden, some with a zero byte, some excluded."""
    root = folder(s, "tree")
    for r in table(s, d, "nation").collect():
        k = r["n_nationkey"]
        path = f"{root}/{'_r' if k % 3 == 0 else '.r'}{r['n_regionkey']}/n{k}{'.log' if k % 7 == 1 else '.py'}"
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w", encoding="utf-8") as f:
            f.write(r["n_name"] + ("\0" if k % 5 == 0 else ""))
    return root


_PATH = "CASE WHEN n_nationkey%3=0 THEN '_r' ELSE '.r' END||n_regionkey||'/n'||n_nationkey||CASE WHEN n_nationkey%7=1 THEN '.log' ELSE '.py' END"
_q("scan_list_paths", f"SELECT {_PATH} AS path FROM nation WHERE n_nationkey%7<>1", lambda s, d: s.createDataFrame([(p,) for p in fs.list_paths(_tree(s, d), ["*.log"])], "path string"))
_q("scan_file", f"SELECT {_PATH} AS path, length(n_name)+CASE WHEN n_nationkey%5=0 THEN 1 ELSE 0 END AS size, CASE WHEN n_nationkey%5=0 THEN 'skipped' ELSE 'file' END AS state, CASE WHEN n_nationkey%5<>0 AND n_nationkey%7<>1 THEN 'python' END AS lang FROM nation", lambda s, d: fs.scan(s, _tree(s, d)).select("path", "size", "state", "lang"))
_q("files", f"SELECT {_PATH} AS path, 32 AS hash_length FROM nation WHERE n_nationkey%5<>0 AND n_nationkey%7<>1", lambda s, d: fs.scan(s, _tree(s, d), ["*.log"]).where("state = 'file'").select("path", F.length("hash").alias("hash_length")))


def _logs(s: SparkSession, d: str) -> list[str]:
    """A log for each region: a line per nation, and one that is not complete."""
    root, paths = folder(s, "logs"), []
    for r in table(s, d, "region").collect():
        names = [x["n_name"] for x in table(s, d, "nation").where(F.col("n_regionkey") == r["r_regionkey"]).orderBy("n_nationkey").collect()]
        paths.append(f"{root}/{r['r_regionkey']}.jsonl")
        with open(paths[-1], "w", encoding="utf-8", newline="\n") as f:
            f.write("".join(json.dumps({"type": "assistant", "n": n}) + "\n" for n in names) + '{"type":"us')
    return paths


def _tails(s: SparkSession, d: str, skip: int) -> DataFrame:
    rows = fs.tails(s.createDataFrame([(p, skip) for p in _logs(s, d)], "path string, offset long"))
    return rows.withColumn("region", F.regexp_extract("path", r"(\d+)\.jsonl$", 1).cast("int"))


_q("scan_log_tail", "SELECT n_regionkey AS region, n_name AS name FROM nation", lambda s, d: _tails(s, d, 0).where("value is not null").select("region", F.get_json_object("value", "$.n").alias("name")))
_LINE = "length('{\"type\": \"assistant\", \"n\": \"\"}')+length(n_name)+1"
_q("st_tail_offsets", f"SELECT n_regionkey AS region, sum({_LINE})::BIGINT AS next FROM nation GROUP BY 1", lambda s, d: _tails(s, d, 0).where("value is null").select("region", "next"))
_q("st_resume_skip", f"SELECT n_regionkey AS region, sum({_LINE})::BIGINT AS offset FROM nation GROUP BY 1", lambda s, d: s.createDataFrame([(int(os.path.basename(p).split(".")[0]), fs.resume_offset(p)) for p in _logs(s, d)], "region int, offset long"))
_q("scan_resume_offset", ORACLES["st_resume_skip"], QUERIES["st_resume_skip"])


def _runs(s: SparkSession, d: str) -> DataFrame:
    root = folder(s, "runs")
    for r in table(s, d, "nation").collect():
        os.makedirs(f"{root}/batch/{r['n_nationkey']}", exist_ok=True)
        with open(f"{root}/batch/{r['n_nationkey']}/row.json", "w", encoding="utf-8") as f:
            json.dump({"v": 1, **({"bench": {"task": r["n_name"]}} if r["n_regionkey"] else {})}, f, indent=1)
    return logs.result_tree(s, root, "v int, bench struct<task: string>").select("bench.task")


_q("scan_json_tree", "SELECT n_name AS task FROM nation WHERE n_regionkey<>0", _runs)


def _appended(s: SparkSession, d: str) -> DataFrame:
    path = folder(s, "rows") + "/log"
    rows = table(s, d, "nation").select("n_name", "n_nationkey")
    for part in (rows, rows.where("n_regionkey = 1")):
        append_rows(part, path)
    return s.read.text(path).groupBy("value").agg(F.count("*").alias("n"))


_q("sink_append_row", "SELECT '{\"n_name\":\"'||n_name||'\",\"n_nationkey\":'||n_nationkey||'}' AS value, CASE WHEN n_regionkey=1 THEN 2 ELSE 1 END::BIGINT AS n FROM nation", _appended)


def _written(s: SparkSession, d: str) -> DataFrame:
    path = folder(s, "out")
    texts = table(s, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("name"), F.col("n_name").alias("text"), "n_regionkey")
    first, again = write_changed(texts.select("name", "text"), path), write_changed(texts.select("name", "text"), path)
    changed = write_changed(texts.where("n_regionkey <> 2").select("name", F.when(F.col("n_regionkey") == 1, "new").otherwise(F.col("text")).alias("text")), path)
    return s.createDataFrame([(first, again, changed, len([p for p in os.listdir(path) if not p.startswith(".")]))], "first long, again long, changed long, left_over long")


_q("sink_write_if_changed", "SELECT count(*) AS first, 0::BIGINT AS again, count_if(n_regionkey=1)::BIGINT AS changed, count_if(n_regionkey<>2)::BIGINT AS left_over FROM nation", _written)


def _shards(s: SparkSession, d: str) -> DataFrame:
    """Text parts of each folder of the go tree, written as files."""
    c = code.index(s, d)
    lines = c.symbols.where("path like 'go/%'").groupBy("path").agg(F.array_sort(F.collect_list("name")).alias("names"))
    parts = tools.packed_parts(lines.select(F.regexp_extract("path", r"^go/([^/]*)/", 1).alias("dir"), F.col("path").alias("place"), F.concat(F.array("path"), "names").alias("lines")), 400)
    path = folder(s, "shards")
    write_changed(parts.select(F.concat("dir", F.when(F.col("part") > 1, F.concat(F.lit("~"), F.col("part").cast("string"))).otherwise("")).alias("name"), "text"), path)
    return s.read.text(path).select(F.col("value").alias("line"))


_q("sink_shards", f"WITH {code.DUCK} SELECT path AS line FROM (SELECT DISTINCT path FROM symbols WHERE starts_with(path, 'go/')) UNION ALL SELECT name FROM symbols WHERE starts_with(path, 'go/')", _shards)


def _store(s: SparkSession, d: str) -> Store:
    c = code.index(s, d)
    files = c.files.where("path like 'go/%'").withColumn("mtime_ns", F.lit(1).cast("long"))
    store = Store(s, folder(s, "store"))
    own = lambda df: df.where("path like 'go/%'")
    store.put_files(files, own(c.symbols), own(c.targets).select("path", "target", F.lit(None).cast("string").alias("resolved")), own(c.refs).withColumn("kind", F.lit("call")))
    return store


def _counts(s: SparkSession, store: Store) -> DataFrame:
    return s.createDataFrame(list(store.counts().items()), "table_name string, n long")


_COUNTS = f"WITH {code.DUCK} SELECT 'files' AS table_name, count(*) AS n FROM files WHERE starts_with(path, 'go/') UNION ALL SELECT 'symbols', count(*) FROM symbols WHERE starts_with(path, 'go/') UNION ALL SELECT 'imports', count(*) FROM imports WHERE starts_with(path, 'go/') UNION ALL SELECT 'refs', count(*) FROM (SELECT DISTINCT * FROM refs WHERE starts_with(path, 'go/'))"


def _compacted(s: SparkSession, d: str) -> DataFrame:
    store = _store(s, d)
    store.compact()
    return _counts(s, store)


def _cleared(s: SparkSession, d: str) -> DataFrame:
    store = _store(s, d)
    store.clear()
    return _counts(s, store)


_q("index", _COUNTS, lambda s, d: _counts(s, _store(s, d)))
_q("status", _COUNTS, lambda s, d: _counts(s, _store(s, d)).orderBy("table_name"))
_q("sink_compact", _COUNTS, _compacted)
_q("sink_clear", "SELECT unnest(['files', 'symbols', 'imports', 'refs']) AS table_name, 0::BIGINT AS n", _cleared)


def _updated(s: SparkSession, d: str) -> DataFrame:
    """Deleting the tests and reading them again gives the symbols of a full build."""
    store, c = _store(s, d), code.index(s, d)
    tests = c.files.where("path like 'go/%' and is_test").withColumn("mtime_ns", F.lit(2).cast("long"))
    own = lambda df: df.where("path like 'go/%'").join(tests.select("path"), "path", "left_semi")
    store.delete_files(tests)
    store.put_files(tests, own(c.symbols), own(c.targets).select("path", "target", F.lit(None).cast("string").alias("resolved")), own(c.refs).withColumn("kind", F.lit("call")))
    return store.table("symbols").select("path", "name", "start_line")


_q("update", f"WITH {code.DUCK} SELECT path, name, start_line FROM symbols WHERE starts_with(path, 'go/')", _updated)


def _manifest(s: SparkSession, d: str) -> DataFrame:
    """A manifest of each task as one JSON document on disk, its anchors and files in order, read back."""
    path = folder(s, "manifests")
    tags = classify.tags(rules._lines(s, d))
    docs = tags.groupBy("task").agg(F.to_json(F.struct(F.array_sort(F.collect_list(F.struct("path", "line", "kind", "note"))).alias("anchors"), F.count("*").alias("n"))).alias("text"))
    write_changed(docs.select(F.concat("task", F.lit(".json")).alias("name"), "text"), path)
    back = s.read.schema("anchors array<struct<path: string, line: long, kind: string, note: string>>, n long").json(path).withColumn("task", F.regexp_extract(F.input_file_name(), r"([^/]*)\.json$", 1))
    return back.select("task", "n", F.element_at("anchors", 1)["path"].alias("first"))


_q("sink_manifest", f"SELECT task, count(*) AS n, min(path) AS first FROM ({rules._TAGS}) GROUP BY task", _manifest)
