"""Logs and result trees as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import TELEMETRY


def telemetry(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Rows of version 1 and a known kind with the file they come from; other lines are skipped."""
    lines = spark.read.text(paths).withColumn("from_file", F.input_file_name())
    rows = lines.select("from_file", F.from_json("value", TELEMETRY).alias("r")).where("r.v = 1 and r.kind in ('turn', 'subagent')")
    return rows.select("from_file", "r.*")


def result_tree(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Every row.json below the folder that has a `bench` object."""
    return spark.read.schema(schema).option("recursiveFileLookup", "true").option("multiLine", "true").option("pathGlobFilter", "row.json").json(folder).where("bench is not null")
