"""The corpus pipeline: stages that clean and encode `documents`, each on all that the one before it kept.

toxicity drops documents that the clause grammar scores at 0.5 or more; near_dedup keeps one document of each group of near
duplicates, the one with the smallest doc_id; suffix_dedup cuts the bytes that a document with a smaller doc_id has in a run
of 50 (bytes of a character that is cut through go with it); decontamination drops documents that hold a benchmark window;
encoding gives the token ids of what is left.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm._exchange import settle
from loomgraph.llm.bpe import bpe_round_trip
from loomgraph.llm.decontam import without_contaminated
from loomgraph.llm.minhash import near_duplicates
from loomgraph.llm.queries import RANKS, fold, table
from loomgraph.llm.suffix import suffix_dedup
from loomgraph.llm.toxicity import fit_grammar, without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_toxic(docs, fit_grammar(docs, table(spark, sf_dir, "labels").where(fold(5) != 0)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row is a document of its own, also where rows repeat a doc_id or have none. Of a group the row stays that comes
    first by doc_id (none comes last), then by text; of rows alike in both, one. Texts without words are near to nothing."""
    if docs.groupBy("doc_id").count().where("doc_id is null or count > 1").isEmpty():
        copies = near_duplicates(docs).where(~F.col("kept")).select("doc_id")
        return docs.join(copies, "doc_id", "left_anti").select(docs.columns)
    # rows get keys in that order; the first key also splits a large group of equal rows
    placed = docs.withColumn("__row", F.monotonically_increasing_id()).orderBy(F.col("doc_id").asc_nulls_last(), "text", "__row")
    keyed = settle(placed.withColumn("__row", F.monotonically_increasing_id()))
    copies = near_duplicates(keyed.select(F.col("__row").alias("doc_id"), "text")).where(~F.col("kept")).select(F.col("doc_id").alias("__row"))
    return keyed.join(copies, "__row", "left_anti").select(docs.columns)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that repeat a doc_id cut nothing from each other; rows without doc_id stay whole and cut nothing."""
    rest = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    out = suffix_dedup(docs, carry=rest, with_text=True)
    own = {"doc_id": F.col("doc_id"), "text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return out.select([(own.get(c) if c in own else F.col("__carry").getField(c)).alias(c) for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row is judged by its own text, also where rows repeat a doc_id or have none."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark")).select(docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe_round_trip(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, with_ids=True)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("suffix_array_dedup", suffix_array_dedup), ("decontamination", decontamination), ("encoding", encoding)]

#: Learned scores, components and merges have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What a stage keeps is settled before the next one, which reads it several times."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if k == 0 else settle(docs), sf_dir)
    return docs
