"""Roll-ups over a growing log with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.transcripts import entries
from ..operators.transcripts import session_totals as session_rows


def read_log(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """JSON lines as they arrive; lines that do not parse are null rows and are dropped."""
    return spark.readStream.schema("value string").text(folder).select(F.from_json("value", schema).alias("r")).where("r is not null").select("r.*")


def session_totals(log: DataFrame, at: str = "at", late: str = "1 hour") -> DataFrame:
    """Tokens and rows per session and day, late rows up to the watermark."""
    return log.withWatermark(at, late).groupBy(F.window(at, "1 day"), "session").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n"))


def append_once(totals: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Every batch goes to its own folder by its id, so a repeated batch replaces itself."""

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").json(f"{path}/batch={batch_id}")

    return totals.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start()


def collect_lines(spark: SparkSession, folder: str, path: str, checkpoint: str) -> StreamingQuery:
    """Lines of session logs as they arrive, each session a file's name, in a table with a folder for every batch.

    A batch that is repeated after a failure replaces its own folder, so a line is never
    counted twice; `sessions_so_far` reads the table as one log.
    """

    def put(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("ord", F.lit(batch_id).cast("long") * (1 << 40) + F.monotonically_increasing_id())
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    lines = spark.readStream.schema("value string").text(folder).select(F.regexp_extract(F.input_file_name(), r"([^/]*?)(?:~[^/]*)?\.jsonl$", 1).alias("session"), "value")
    return lines.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sessions_so_far(spark: SparkSession, path: str, server: str) -> DataFrame:
    """Totals per session over all batches: messages and tool calls that came again in a later batch still count once."""
    lines = spark.read.schema("session string, value string, ord long, batch int").parquet(path)
    return session_rows(entries(lines, server))
