"""From raw documents to packed sequences in five stages.

Each stage takes the documents that the one before it kept, as Parquet, and
returns the columns of documents; the last returns packed pieces.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tarn.llm import _store, forest, mil, packing, queries, rules, suffix

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Words that a worker of the last stage remembers: executors have been through four others by then.
MEMORY = 300_000


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy keeps."""
    return rules.keep(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a classifier, fitted on the labelled ones of the whole corpus, scores at its threshold or above."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return mil.keep(docs, mil.train(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return forest.keep_first(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that an earlier one has."""
    return suffix.remove_repeats(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' ids as pieces of sequences."""
    return packing.pack(docs, public_tokenizers.path(queries.WORD_BPE), end=1, memory=MEMORY)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("packing", packed),
]

#: Token ids and differencing have no SQL form; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage for the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = _store.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
