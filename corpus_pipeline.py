"""From raw documents to packed sequences, one operator a stage.

Every stage but the last returns the columns of documents; each is written as
Parquet and read again as the next one's input.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from samplight.llm import exact_dedup, langid, minhash, packing, quality
from samplight.llm.common import documents, stage


#: Words whose ids a worker keeps in packing; fewer than by itself, as the stages before it have filled the heap.
PACK_WORDS = 160_000


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter or with an uncertain language."""
    return langid.keep_identified(docs, langid.train(docs))


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the weighed rules find bad."""
    return quality.keep_good(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of equal texts."""
    return exact_dedup.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each near-duplicate group (similarity of 0.8 or more)."""
    return minhash.keep_representatives(docs, percent=80)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places the pieces of what is left in sequences."""
    return packing.pack(docs, store_words=PACK_WORDS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", identify_language),
    ("quality", filter_quality),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("packing", pack_sequences),
]

#: Trained models and groups of similar sets have no SQL; tests/llm/test_pipeline.py compares with a brute-force version of every stage.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
