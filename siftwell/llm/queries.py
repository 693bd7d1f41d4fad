"""Queries over the ten operators, with production parameters, on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siftwell.llm import licences, mixing, rules
from siftwell.llm.common import table


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: The production mixture: domains by source number; weights of domains, languages and sources.
DOMAINS = ("web", "reference", "forum", "news")
WEIGHTS = {
    ("web",): 4,
    ("reference",): 3,
    ("forum",): 1,
    ("news",): 2,
    ("web", "en"): 3,
    ("web", "de"): 2,
    ("reference", "en"): 2,
    ("reference", "fr"): 2,
    ("news", "es"): 3,
    ("web", "en", "src0"): 2,
    ("forum", "de", "src2"): 3,
}
MIX = {"share": 1.0, "epochs": 4, "seed": 17}


def mixing_plan() -> dict:
    return MIX | {"domain": mixing.source_domain("source", DOMAINS), "weights": WEIGHTS}


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mixture(table(spark, sf_dir, "documents"), **mixing_plan())
    return mixed.select("doc_id", "mix_domain", "lang", "source", "mix_epoch", "n_tokens", "take_tokens")


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftwell.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftwell.llm.ordinal import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftwell.llm.jpeg import store_as_jpeg

    return store_as_jpeg(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftwell.llm.rules import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"))


def op6_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(spark, table(spark, sf_dir, "documents"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftwell.llm.maxent import language_model

    return language_model(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftwell.llm.edits import count_edits, sample_edits

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", sample_edits().alias("edits"))
    return count_edits(docs, word_tokenizer())


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftwell.llm.urls import filter_urls

    return filter_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftwell.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), word_tokenizer())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_source_mixing": op1_source_mixing,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_media_columns": op4_media_columns,
    "op5_quality_rules": op5_quality_rules,
    "op6_license_scans": op6_license_scans,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_token_counts": op8_token_counts,
    "op9_url_filters": op9_url_filters,
    "op10_best_fit_packing": op10_best_fit_packing,
}

ORACLES: dict[str, str] = {
    "op1_source_mixing": mixing.oracle(DOMAINS, WEIGHTS, **MIX),
    "op5_quality_rules": rules.ORACLE,
    "op6_license_scans": licences.oracle(),
}
