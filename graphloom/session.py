"""A Spark session with the settings the operators rely on, and tables that are written once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "graphloom", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution, Arrow; a cluster's own settings win over none of these but the master's."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"} | conf
    return builder.config(map=settings).getOrCreate()


def settled(df: DataFrame, name: str) -> DataFrame:
    """The rows, written once below the folder that all executors share: what is read many times is made once, and a lost executor loses nothing.

    Without spark.checkpoint.dir, on a local master only, a folder of the system's is used.
    """
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.gettempdir()
    path = f"{base.rstrip('/')}/graphloom-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
