"""Snapshots: difference, upsert with cascade, latest wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def difference(known: DataFrame, listed: DataFrame, key: str = "path", value: str = "size") -> DataFrame:
    """Keys that are new, changed or gone."""
    k, n = known.select(F.col(key), F.col(value).alias("was")), listed.select(F.col(key), F.col(value).alias("now"))
    state = F.when(F.col("has_k").isNull(), "new").when(F.col("has_n").isNull(), "gone").when(~F.col("was").eqNullSafe(F.col("now")), "changed")
    return k.withColumn("has_k", F.lit(1)).join(n.withColumn("has_n", F.lit(1)), key, "full_outer").withColumn("state", state).where("state is not null").select(key, "state")


def upsert(old: DataFrame, new: DataFrame, key: str = "path") -> DataFrame:
    """All rows of the new keys in place of the old ones; children of a key go with it."""
    return old.join(new.select(key).distinct(), key, "left_anti").select(*old.columns).unionByName(new)


def delete(old: DataFrame, gone: DataFrame, key: str = "path") -> DataFrame:
    return old.join(gone.select(key).distinct(), key, "left_anti").select(*old.columns)


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    best = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(o) for o in order]))
    return rows.withColumn("__r", best).where("__r = 1").drop("__r")


def fill_missing(rows: DataFrame, values: DataFrame, keys: list[str], column: str) -> DataFrame:
    """The column from `values` only where it is null."""
    v = values.select(*keys, F.col(column).alias("__new"))
    return rows.join(v, keys, "left").withColumn(column, F.coalesce(column, "__new")).drop("__new")


def newest(rows: DataFrame, order: str, keep: int, key: str) -> DataFrame:
    """The newest `keep` rows: a top-k, so every task sends only its own best."""
    return rows.orderBy(F.desc(order), key).limit(keep)
