"""Token-id output: whole texts to Simple-8b files in ascending id order, and back.

Documents are range-partitioned and sorted by id; each task encodes its run into files of
about `file_ids` ids. The files are the rows of a table in the shared folder, one binary
each, so the table's commit leaves no file of a lost or repeated task behind.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import lookup, new_path, shuffle_width
from .simple8b import read_file, write_file
from .tokens import encoder, gathered, portions, vocabulary_path

FILE_IDS = 1 << 21
#: Bytes of text that are encoded together: the more, the fewer different pieces are looked up.
PORTION = 4 << 20
_FILE = "shard long, piece long, n_docs long, n_ids long, data binary"


def _write(vocabulary: str, end_id: int, file_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        encode_all = encoder(vocabulary).encode_all
        docs, lengths, parts, held, piece = [], [], [], 0, 0

        def flush() -> pa.RecordBatch:
            ids = np.concatenate(parts)
            return pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([piece]), pa.array([len(docs)]), pa.array([len(ids)]), pa.array([write_file(docs, np.concatenate(lengths), ids)], pa.binary())], names=["shard", "piece", "n_docs", "n_ids", "data"])

        for batch in gathered(batches, PORTION):
            for portion in portions(batch, 1, min(PORTION, 4 * file_ids)):
                ids, sizes = encode_all(portion.column(1), end_id)
                docs += portion.column(0).to_pylist()
                lengths.append(sizes)
                parts.append(ids)
                held += len(ids)
                if held >= file_ids:
                    yield flush()
                    docs, lengths, parts, held, piece = [], [], [], 0, piece + 1
        if docs:
            yield flush()

    return run


def write_token_files(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end_id: int = 0, file_ids: int = FILE_IDS) -> None:
    """Encode every whole text (null: empty), append end_id, write files in ascending id order (nulls first, equal ids by text)."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    # the hash deals equal ids, nulls among them, over several ranges
    rows = rows.withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange(shuffle_width(docs.sparkSession), "id", "tie").sortWithinPartitions("id", "tie").select("id", "text")
    rows.mapInArrow(_write(vocabulary or vocabulary_path(), end_id, file_ids), _FILE).write.parquet(path)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, data in zip(batch.column("start").to_pylist(), batch.column("data"), strict=True):
            docs, lengths, ids = read_file(data.as_buffer())
            ends = np.cumsum(lengths, dtype=np.int64)
            raw = ids.astype("<u4")
            sums = [zlib.crc32(raw[b - n : b].tobytes()) for b, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(start + ends - lengths), pa.array(lengths.astype(np.int64)), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_token_files(spark, path: str) -> DataFrame:
    """Per document of the files: doc_id, start (ids before it), n_tokens (with the end id), ids_crc32."""
    files = spark.read.schema(_FILE).parquet(path)
    # One row for each task of the writer, then for each file of a task: never a row per document.
    shards = files.groupBy("shard").agg(F.sum("n_ids").alias("own")).withColumn("before", F.sum("own").over(Window.orderBy("shard")) - F.col("own"))
    inside = F.sum("n_ids").over(Window.partitionBy("shard").orderBy("piece")) - F.col("n_ids")
    starts = files.select("shard", "piece", "n_ids").withColumn("inside", inside).join(shards, "shard").select(_file_key().alias("key"), (F.col("before") + F.col("inside")).alias("start"))
    # one row a file: the files' bytes don't move to meet their starts
    placed = lookup(files.select(_file_key().alias("key"), "data"), starts, "key", files.count(), "inner")
    return placed.select("start", "data").mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _file_key() -> Column:
    return F.shiftleft(F.col("shard"), 32) + F.col("piece")


def token_file_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end_id: int = 0) -> DataFrame:
    """Write the files to the shared folder, then give what the files hold of every document.

    A file is one binary value of the format that `simple8b` describes, in a table that Spark
    commits as a whole; `write_file` gives the same bytes for a file of its own.
    Null and empty texts are the end id alone; repeated rows are repeated documents; other
    columns are not read; an empty table gives no files and no rows.
    """
    path = new_path(docs.sparkSession, "token_files")
    write_token_files(docs, path, id_col, text_col, vocabulary, end_id)
    return read_token_files(docs.sparkSession, path)
