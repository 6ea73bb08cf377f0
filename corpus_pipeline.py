"""A training corpus from raw documents: language, near copies, repeated passages, mix, packed sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rankloom.llm import language_id, mixing, ngram_jaccard, substring_dedup, tier_packing
from rankloom.llm.common import drop_stored, finished
from rankloom.llm.queries import word_tokenizer


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a language that the labelled rows teach, with a calibrated probability of a half at least."""
    return language_id.in_known_language(docs, language_id.train(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group linked by five-word shingles at a Jaccard similarity of 0.8 or more."""
    return ngram_jaccard.one_of_each(docs, words=5, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages that stand in several documents out of all but the first."""
    return substring_dedup.without_repeats(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that sources reach their target weights."""
    return mixing.mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in packed sequences of token ids."""
    return tier_packing.pack(docs, word_tokenizer())


STAGES = [("language_id", languages), ("near_copies", near_copies), ("repeated_passages", repeated_passages), ("mixture", mixture), ("packing", packing)]

# Stages train a model, hash texts and call a tokenizer, which SQL cannot express; tests/llm holds each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of a folder, each written to the shared folder before the next.

    What a stage wrote on its way, and the stage before it, is removed once its result is written.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = finished(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), spark, name)
        if before is not None:
            drop_stored(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
