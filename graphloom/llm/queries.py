"""The queries of this subpackage, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .conversation_repair import repair_digest
from .embedding_dedup import near_duplicate_vectors
from .filter_audit import AUDIT_SQL, audit
from .language_id import language_of
from .minhash_dedup import near_duplicate_documents
from .mixing import mix, source_levels
from .packing import pack
from .pattern_packing import pack_by_patterns
from .quality_rules import quality_of
from .recurrent_lm import model_scores
from .token_files import token_file_digest
from .url_filter import url_verdicts
from .winnowing import fingerprints


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(_table(spark, sf_dir, "embeddings"))


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_documents(_table(spark, sf_dir, "documents"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file_digest(_table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mix(_table(spark, sf_dir, "documents").drop("n_chars"), source_levels())
    return found.select("doc_id", "lang", "source", "epoch", "n_tokens", "leaf_budget")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_of(_table(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(_table(spark, sf_dir, "pages"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_of(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(_table(spark, sf_dir, "documents"))


def op9_recurrent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model_scores(_table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_digest(_table(spark, sf_dir, "conversations"))


def op12_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_by_patterns(_table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_embedding_dedup, op2_minhash_dedup, op3_mixing, op4_token_files, op5_language_id, op6_url_filter, op7_winnowing, op8_packing, op9_recurrent_lm, op10_quality_rules, op11_conversation_repair, op12_pattern_packing, op13_filter_audit)}
ORACLES: dict[str, str] = {"op13_filter_audit": AUDIT_SQL}
