"""A corpus pipeline: quality, language, near duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and reread as the next stage's docs. All but the last return the columns of their input,
whatever those are named beside doc_id, text, lang and source; all work on every row and on
whole texts, and give no rows for an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import language_id, mixing, packing, quality_rules
from graphloom.llm.minhash_dedup import near_duplicate_documents
from graphloom.llm.shared import discard, settle


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the rules score at 0.5 or more; learned from the labelled ones among them.

    A null text is scored as an empty one. Repeated rows get the same score. Null ids have no label.
    """
    return quality_rules.accepted(docs, quality_rules.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows with a language: a letter, and a first language that makes up half of the mixture; learned from the rows with text and lang.

    Null texts and texts without a letter go. Repeated rows get the same language.
    """
    return language_id.in_a_language(docs, language_id.train(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: that with the least id, and one row where an id stands in several.

    Rows with a null id are told apart by their texts and stay behind documents with an id.
    Texts without words are nobody's duplicates.
    """
    # ids of null-id rows lie above 2^62, so a document with an id of its own is preferred
    ident = F.coalesce(F.col("doc_id").cast("long"), F.expr("(xxhash64(text) & 4611686018427387903L) | 4611686018427387904L"))
    keyed = docs.select(ident.alias("id"), F.struct("*").alias("row"))
    found = settle(near_duplicate_documents(keyed.select("id", "row.text"), "id").select("id", "kept"), "found")
    gone = found.where("not kept").select("id").distinct()
    repeated = settle(found.groupBy("id").count().where("count > 1").select("id"), "repeated")
    # merged at every size: the documents move once, whatever the planner thinks of the ids
    stay = keyed.join(gone.hint("merge"), "id", "left_anti")
    if repeated.isEmpty():
        discard(repeated)
        return stay.select("row.*")
    several = settle(stay.join(repeated, "id", "left_semi").withColumn("mark", F.xxhash64("row.text")), "several")
    first = several.groupBy("id").agg(F.min("mark").alias("mark"))
    return stay.join(repeated, "id", "left_anti").select("row.*").union(several.join(first, ["id", "mark"], "left_semi").dropDuplicates(["id"]).select("row.*"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Four fifths of the words by the weights of the tree of domains, languages and sources, every row at most once.

    Null languages and sources are leaves of their own; texts without words cost nothing.
    """
    return mixing.chosen_rows(docs, mixing.source_levels(), share=0.8, epochs=1.0).select("row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document in a sequence of at most 2048 ids; a null text is its end id alone."""
    # workers carry the memory of the stages before, so they remember fewer pieces
    return packing.pack(docs, remembered=64 << 20)


STAGES = [("quality", quality), ("language", language), ("near_duplicates", near_duplicates), ("mixture", mixture), ("packed", packed)]

#: Trained models and forest candidates have no SQL; tests/llm/test_pipeline_stages.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        docs, before = settle(stage(spark, docs, sf_dir), name), docs
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
