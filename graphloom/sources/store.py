"""A code map's tables on disk: every change writes a new snapshot, and a pointer names the one that readers see."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "files": "path string, dir string, lang string, hash string, size long, mtime_ns long, doc string, is_test boolean",
    "symbols": "path string, id long, name string, kind string, parent string, signature string, start_line long, end_line long, visibility string, doc string, doc_source string",
    "imports": "path string, target string, resolved string",
    "refs": "path string, line long, name string, kind string",
    "skipped": "path string, size long, mtime_ns long",
    "meta": "key string, value string",
}
CHILDREN = ("symbols", "imports", "refs")
KEYS = {"files": ["path"], "symbols": ["path", "id"], "imports": ["path", "target"], "refs": ["path", "line", "name", "kind"], "skipped": ["path"], "meta": ["key"]}


class Store:
    """Readers see the tables that `CURRENT` names until a change is complete; tables that a change leaves alone are shared."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def current(self) -> dict[str, str]:
        """Where each table lies."""
        if not self._fs().exists(self._path("CURRENT")):
            return {}
        return json.loads("".join(r["value"] for r in self.spark.read.text(f"{self.folder}/CURRENT").collect()))

    def _point(self, places: dict[str, str]) -> None:
        fs, jvm = self._fs(), self.spark._jvm
        temp = self._path(f"_CURRENT-{uuid.uuid4().hex}")
        out = fs.create(temp, True)
        out.write(bytearray(json.dumps(places, sort_keys=True).encode()))
        out.close()
        fs.delete(self._path("CURRENT"), False)
        if not fs.rename(temp, self._path("CURRENT")):
            raise OSError("the pointer could not be moved")
        del jvm

    def table(self, name: str) -> DataFrame:
        place = self.current().get(name)
        return self.spark.read.schema(SCHEMAS[name]).parquet(place) if place else self.spark.createDataFrame([], SCHEMAS[name])

    def write(self, tables: dict[str, DataFrame]) -> None:
        """Replace these tables together; repeated keys are kept once."""
        places, change = self.current(), uuid.uuid4().hex
        for name, df in tables.items():
            place = f"{self.folder}/{change}/{name}"
            df.dropDuplicates(KEYS[name]).select(*[c.split()[0] for c in SCHEMAS[name].split(", ")]).write.parquet(place)
            places[name] = place
        self._point(places)

    def put_files(self, files: DataFrame, symbols: DataFrame, imports: DataFrame, refs: DataFrame) -> None:
        """Insert or replace files with all that hangs on them."""
        gone = files.select("path")
        new = {"files": files, "symbols": symbols, "imports": imports, "refs": refs}
        self.write({n: self.table(n).join(gone, "path", "left_anti").unionByName(df, allowMissingColumns=True) for n, df in new.items()})

    def delete_files(self, paths: DataFrame) -> None:
        """Delete files and all that hangs on them."""
        self.write({n: self.table(n).join(paths.select("path"), "path", "left_anti") for n in ("files", *CHILDREN)})

    def touch(self, stats: DataFrame) -> None:
        """New size and time of files; nothing else changes."""
        self.write({"files": touched(self.table("files"), stats)})

    def set_resolved(self, found: DataFrame) -> None:
        """New targets of imports by path and target."""
        self.write({"imports": resolved(self.table("imports"), found)})

    def skip(self, rows: DataFrame, back: DataFrame | None = None) -> None:
        """Remember files that aren't read; `back` are read again."""
        left = self.table("skipped").join(rows.select("path"), "path", "left_anti").unionByName(rows)
        self.write({"skipped": left.join(back.select("path"), "path", "left_anti") if back is not None else left})

    def set_meta(self, values: dict[str, str]) -> None:
        new = self.spark.createDataFrame(list(values.items()), SCHEMAS["meta"])
        self.write({"meta": self.table("meta").join(new.select("key"), "key", "left_anti").unionByName(new)})

    def meta(self, key: str) -> str | None:
        row = self.table("meta").where(F.col("key") == key).first()
        return row["value"] if row else None

    def clear(self) -> None:
        """All tables but meta empty."""
        self.write({n: self.spark.createDataFrame([], s) for n, s in SCHEMAS.items() if n != "meta"})

    def compact(self, parts: int = 1) -> None:
        """Rewrite the tables in few files and delete all that readers no longer see."""
        self.write({n: self.table(n).coalesce(parts) for n in SCHEMAS})
        kept = {p.rsplit("/", 2)[1] for p in self.current().values()}
        for item in self._fs().listStatus(self._path(".")):
            name = item.getPath().getName()
            if item.isDirectory() and name not in kept:
                self._fs().delete(item.getPath(), True)

    def counts(self) -> dict[str, int]:
        return {n: self.table(n).count() for n in ("files", *CHILDREN)}


def touched(files: DataFrame, stats: DataFrame) -> DataFrame:
    new = stats.select("path", F.col("size").alias("__size"), F.col("mtime_ns").alias("__time"))
    return files.join(new, "path", "left").withColumns({"size": F.coalesce("__size", "size"), "mtime_ns": F.coalesce("__time", "mtime_ns")}).drop("__size", "__time")


def resolved(imports: DataFrame, found: DataFrame) -> DataFrame:
    """Targets by path and target; a null that is found counts too."""
    new = found.select("path", "target", F.col("resolved").alias("__new"), F.lit(True).alias("__set"))
    return imports.join(new, ["path", "target"], "left").withColumn("resolved", F.when(F.col("__set"), F.col("__new")).otherwise(F.col("resolved"))).drop("__new", "__set")


def append_rows(rows: DataFrame, path: str) -> None:
    """Rows as compact JSON lines with sorted keys, behind those that are there."""
    rows.select(F.to_json(F.struct(*sorted(rows.columns))).alias("value")).write.mode("append").text(path)


def write_changed(texts: DataFrame, folder: str) -> int:
    """Write texts (name, text) as files where they differ from what is there, delete files that have no text any more; how many were written.

    Only names and hashes are compared; a file appears under its name when it is complete.
    """
    spark = texts.sparkSession
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    base = jvm.org.apache.hadoop.fs.Path(folder)
    fs = base.getFileSystem(conf)
    fs.mkdirs(base)
    there = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select(F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), F.md5("content").alias("old"))
    rows = texts.join(there, "name", "full_outer").where("text is null or old is null or md5(cast(text as binary)) <> old")
    written = 0
    for row in rows.select("name", "text").toLocalIterator():
        target = jvm.org.apache.hadoop.fs.Path(base, row["name"])
        if row["text"] is None:
            fs.delete(target, False)
            continue
        temp = jvm.org.apache.hadoop.fs.Path(base, f".{row['name']}-{uuid.uuid4().hex}")
        out = fs.create(temp, True)
        out.write(bytearray(row["text"].encode()))
        out.close()
        fs.delete(target, False)
        fs.rename(temp, target)
        written += 1
    return written
