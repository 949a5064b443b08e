"""The queries of this subpackage and the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from zonalis.llm import fuzzy_lines, licenses, lloyd, media_avi, mixing, near_dup, packing, quality, secrets, sharding, url_reputation, variants, warc
from zonalis.llm.oracles import ORACLE_SQL as ORACLE_SQL


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.revisit_report(_table(spark, sf_dir, "pages"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"))


def op3_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_reputation.judge_urls(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "labels"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_dup_report(_table(spark, sf_dir, "documents"))


def op5_avi_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_avi.media_report(_table(spark, sf_dir, "documents"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy_lines.line_report(_table(spark, sf_dir, "documents"))


def op8_quality_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(_table(spark, sf_dir, "documents"))


def op9_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(_table(spark, sf_dir, "documents"))


def op11_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lloyd.cluster_report(_table(spark, sf_dir, "embeddings"))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_report(_table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variant_report(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_warc_revisits, op2_sharding, op3_url_reputation, op4_near_duplicates, op5_avi_media, op6_secret_scan, op7_fuzzy_lines, op8_quality_outliers, op9_best_two_fit, op10_source_mix, op11_lloyd, op12_license_scan, op13_spelling_variants)}
