"""The queries of this subpackage, each over its whole table with production parameters, and their DuckDB SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import fingerprint, mixing, neighbours, ngram_join, packing, pii, quality, suffix, toxicity, urls
from .common import read


def op6_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op1_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.sketch(read(spark, sf_dir, "documents"))


def fingerprint_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report on op1's sketches: what holds the documents whose id is divisible by 20."""
    return fingerprint.contained(fingerprint.sketch(read(spark, sf_dir, "documents")))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.groups(read(spark, sf_dir, "documents"))


def op3_url_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(read(spark, sf_dir, "pages"))


def op5_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.repeats(read(spark, sf_dir, "documents"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


def op9_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(read(spark, sf_dir, "documents"))


def op10_hash_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.neighbours(read(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if (k.startswith("op") or k == "fingerprint_containment") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op1_scaled_sketch": fingerprint.ORACLE, "fingerprint_containment": fingerprint.CONTAINED, "op7_suffix_dedup": suffix.ORACLE, "op8_source_mixing": mixing.ORACLE}
