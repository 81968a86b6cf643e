"""The queries of this subpackage, `opN_<name>`, and the SQL that DuckDB can run for them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import ann_forest, line_dedup, lm_score, packing, quality, simhash, toxicity, unigram, url_filter
from sparkloom.session import table


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.query(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.query(table(spark, sf_dir, "documents"))


def op4_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.query(table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.query(table(spark, sf_dir, "pages"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.count_tokens(table(spark, sf_dir, "documents"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.query_codec(table(spark, sf_dir, "documents"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_hash_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_forest.query(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_token_counts": op2_token_counts,
    "op3_hash_prefix_forest": op3_hash_prefix_forest,
    "op4_harmonic_packing": op4_harmonic_packing,
    "op5_line_dedup": op5_line_dedup,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_url_filter": op7_url_filter,
    "op8_toxicity": op8_toxicity,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_quality_rules": op10_quality_rules,
}

#: Hashes of shingles, tokenizers and fitted models are beyond SQL; tests/llm hold those queries against plain Python.
ORACLES: dict[str, str] = {
    "op5_line_dedup": line_dedup.SQL,
    "op7_url_filter": url_filter.sql(),
    "op10_quality_rules": quality.sql(),
}
