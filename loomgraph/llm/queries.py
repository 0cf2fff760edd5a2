"""The queries op1 to op10: each operator on its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracle
from .bpe import bpe_round_trip
from .chat import format_chat
from .decontam import decontaminate
from .langid import fit_languages, identify
from .lm import backoff_scores
from .minhash import near_duplicates
from .quality import quality_rules
from .substring import substring_dedup
from .suffix import suffix_dedup
from .toxicity import fit_grammar, toxicity_scores

#: Tools whose calls op5 validates: (name, param, type, required).
TOOLS = (("search", "query", "string", True), ("search", "limit", "integer", False), ("calculate", "expression", "string", True), ("fetch", "url", "string", True), ("fetch", "timeout", "number", False))
RANKS = "byte_bpe_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(n: int) -> Column:
    """crc32 of doc_id as text, modulo n; rows without doc_id are in no fold."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    grammar = fit_grammar(docs, table(spark, sf_dir, "labels").where(fold(5) != 0))
    return toxicity_scores(docs, grammar).select("doc_id", (fold(5) == 0).alias("held_out"), "score", "predicted")


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return bpe_round_trip(table(spark, sf_dir, "documents"), P.path(RANKS), P.PATTERN)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit_languages(docs.where(fold(4) != 2))).select("doc_id", (fold(4) == 2).alias("held_out"), "lang_pred", "score")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ", ".join(f"('{n}', '{p}', '{t}', {str(r).lower()})" for n, p, t, r in TOOLS)
    schemas = spark.sql(f"SELECT * FROM VALUES {rows} AS t(name, param, type, required)")
    return format_chat(table(spark, sf_dir, "conversations"), schemas)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents")).drop("kept")


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff_scores(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_toxicity, op2_minhash_dedup, op3_byte_bpe, op4_language_id, op5_chat_format, op6_quality_rules, op7_suffix_dedup, op8_lm_scores, op9_decontamination, op10_substring_dedup)}

#: Learned scores (op1, op4), merges (op3) and variants (op5) have no SQL: tests hold them against plain versions.
ORACLE_SQL: dict[str, str] = oracle.SQL
