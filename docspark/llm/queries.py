"""The corpus queries: one per operator, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, html_extract, language_id, perplexity, secrets, sharding, simhash, suffix_dedup, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeats(_table(spark, sf_dir, "documents"))


def op2_perplexity_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.accepted(_table(spark, sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(_table(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxic(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(language_id.document_evidence(_table(spark, sf_dir, "documents")), ["doc_id"])


def language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 8 over web pages, with the evidence of markup, address and host."""
    return language_id.identify(language_id.page_evidence(_table(spark, sf_dir, "pages")), ["page_id"])


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith(("op", "language_id_"))}


def oracle_sql() -> dict[str, str]:
    return {"op7_sharding": sharding.ORACLE}
