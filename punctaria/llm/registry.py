"""Queries of the corpus operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe_reuse, decontamination, language_id, near_dedup, oracles, packing, quality_classifier, quality_rules, spelling_variants, suffix_dedup, toxicity, training_order, url_filters
from .common import read


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.query(read(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.query(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op3_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_order.query(read(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.query(read(spark, sf_dir, "documents"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.query(read(spark, sf_dir, "pages"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.query(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.query(read(spark, sf_dir, "documents"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.query(read(spark, sf_dir, "documents"))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.query(read(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.query(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op11_bpe_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_reuse.query(read(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.query(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_quality_rules, op2_toxicity, op3_training_order, op4_packing, op5_url_filters, op6_quality_classifier, op7_language_id, op8_minhash_near_dedup, op9_suffix_array_dedup, op10_decontamination, op11_bpe_reuse, op12_spelling_variants)}
SQL: dict[str, str] = {"op5_url_filters": oracles.OP5, "op8_minhash_near_dedup": oracles.OP8, "op10_decontamination": oracles.OP10, "op12_spelling_variants": oracles.OP12}
