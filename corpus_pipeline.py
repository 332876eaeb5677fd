"""The corpus pipeline: language ID, exact dedup, near-dedup, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandloom.llm import exact_dedup, language_id, mixing, packing, simhash
from strandloom.llm.registry import vocabulary_path
from strandloom.plans.runtime import cut, ready, table


def _language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    return language_id.language_filter(docs)


def _exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    return exact_dedup.exact_dedup(docs)


def _near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    return simhash.near_duplicate_filter(docs, shingle_words=5, similarity=0.8)


def _mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    return mixing.mixed_documents(docs)


def _pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    return packing.pack(docs, vocabulary_path(), capacity=4096, end_id=1)


STAGES = [("language_id", _language), ("exact_dedup", _exact), ("simhash_near_dedup", _near), ("source_mixing", _mix), ("best_fit_packing", _pack)]

#: Trained models, SimHash and tokenizer ids have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written and reread."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
