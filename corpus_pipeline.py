"""The corpus pipeline: documents that are not toxic, one of each near-duplicate class, redacted, mixed and encoded."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lectern.llm import mixing, neardup, pieces, pii, toxicity
from lectern.llm.common import materialise, prepare


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the factorization machine, learned from ``labels``, finds toxic.

    Null and empty texts score the base rate; equal texts go or stay together; without labels of both kinds all stay.
    """
    prepare(spark)
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate class, the one with the least doc_id.

    Null texts count as empty, and those without words are alike only if equal. Rows without doc_id take part and come
    after those with one; of rows that repeat one stays; different texts under one doc_id are looked at apart.
    """
    prepare(spark)
    return neardup.keep_one(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with its personal data replaced by the kind's name and n_chars counted anew.

    Null texts stay null, empty ones empty; rows repeat as they do.
    """
    prepare(spark)
    return pii.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix to the sources' target weights takes it.

    Texts without words (null too) take no words, so they come as often as their source's ratio says; null source and
    doc_id are values like others; repeated rows are drawn one by one.
    """
    prepare(spark)
    return mixing.mix(docs)


def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' columns with piece_ids, and decoded, the text that these ids give back.

    Null and empty texts have no ids and decode to the empty text; rows repeat as they do. In every stage an empty table
    gives no rows and columns beside the documents' own stay as they are, whatever their names.
    """
    prepare(spark)
    return pieces.round_trip(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("minhash_near_dedup", near_dedup_stage),
    ("pii", pii_stage),
    ("source_mixing", mixing_stage),
    ("sentencepiece", sentencepiece_stage),
]

#: The stages hold a learned model and random draws, so SQL cannot express the result.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each stage's result is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
