"""The pipeline's stages: each takes and returns documents, the last returns packed pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the base rules and their group's adaptive thresholds."""
    from siftwell.llm.rules import passing

    return passing(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose probability of the top grade reaches the threshold."""
    from siftwell.llm.common import table
    from siftwell.llm.ordinal import passing

    return passing(docs, table(spark, sf_dir, "labels"))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates."""
    from siftwell.llm.simhash import deduplicate

    return deduplicate(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows by target weights, as often as the epochs of their leaf ask for.

    The row in which a leaf's budget ends keeps the prefix that the budget holds.
    """
    from siftwell.llm.mixing import mixture, prefix
    from siftwell.llm.queries import mixing_plan

    return prefix(mixture(docs, **mixing_plan())).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows, packed."""
    from siftwell.llm.packing import pack
    from siftwell.llm.queries import word_tokenizer

    return pack(docs, word_tokenizer())
