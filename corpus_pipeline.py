"""From raw documents to packed training sequences: five stages, each written and read again before the next one.

Every stage takes (spark, docs, sf_dir) and works on all rows of docs. All but the last return the columns of docs, in
their order and whatever they are; only doc_id and text are looked at. An empty table goes through as one. Null texts
are empty ones to every stage: scores are those of an empty text, and all of them are copies of each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transitspark.llm import packing, quality, secrets, simhash, toxicity
from transitspark.llm.common import crc_of_id, free_name, staged, table
from transitspark.llm.token_files import tokenizer_path

#: Rejected from this score on, and below this score.
TOXIC, POOR = 0.7, 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below TOXIC; learns from the rows that the query learns from. A null text scores
    as an empty one."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), "toxic", crc_of_id("doc_id") % 3 != 1)
    score = free_name(docs, "_toxicity")
    return toxicity.scored(docs, *model, column=score).where(F.col(f"`{score}`") < TOXIC).drop(score)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is POOR or more. A null text scores as an empty one."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"), "quality", crc_of_id("doc_id") % 5 != 0)
    score = free_name(docs, "_quality")
    return quality.scored(docs, *model, column=score).where(F.col(f"`{score}`") >= POOR).drop(score)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (0.8 of their 5-word shingles): the one with the smallest doc_id. Rows
    that share a doc_id stay or go together; rows without one stay."""
    near = simhash.near_copies(docs)
    name = free_name(docs, "_kept")
    kept = near.where("doc_id = component_id").select(F.col("doc_id").alias(name)).distinct()
    named = docs.where("doc_id is not null").join(kept, F.col("doc_id") == F.col(f"`{name}`"), "left_semi")
    return named.union(docs.where("doc_id is null"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret in their texts replaced by a mask; n_chars is counted anew."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document: its sequence of at most 1024 tokens and its place there."""
    return packing.placed(packing.pack(docs, tokenizer_path("byte_bpe_50k.json")))


STAGES = [("toxicity", drop_toxic), ("quality", drop_poor), ("simhash_near_dedup", drop_near_copies), ("secret_scans", mask_secrets), ("best_fit_packing", pack)]
#: Two stages learn models and one tokenises; SQL expresses neither. tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir))
    return docs
