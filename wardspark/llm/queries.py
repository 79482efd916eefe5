"""The registered queries of this subpackage and their DuckDB checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import (
    conversations, decontamination, dedup, filters, fingerprints, language, licenses, mixing, oracle, packing, pages,
    quality, sharding, tokens,
)
from .common import read


def op1_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.contaminated(
        read(spark, folder, "documents"), read(spark, folder, "benchmark")
    )


def op2_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.fingerprint_documents(read(spark, folder, "documents"))


def op3_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return dedup.duplicate_classes(read(spark, folder, "documents"))


def op4_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(read(spark, folder, "documents"))


def op5_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.token_counts(read(spark, folder, "documents"))


def op6_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.classify(read(spark, folder, "documents"), read(spark, folder, "labels"))


def op7_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return pages.extract_pages(read(spark, folder, "pages"))


def op8_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard_documents(read(spark, folder, "documents"))


def op9_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan_licenses(read(spark, folder, "documents"))


def op10_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language.identify(read(spark, folder, "documents"))


def op11_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.repair_damaged(read(spark, folder, "conversations"))


def op12_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_documents(read(spark, folder, "documents"))


def op13_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return filters.audit_filters(read(spark, folder, "documents"), read(spark, folder, "labels"))


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    return corpus_pipeline.run(spark, folder)


QUERIES = {
    "pipeline": pipeline,
    "op1_decontamination": op1_decontamination,
    "op2_fingerprints": op2_fingerprints,
    "op3_near_dedup": op3_near_dedup,
    "op4_packing": op4_packing,
    "op5_token_counts": op5_token_counts,
    "op6_quality": op6_quality,
    "op7_html_extraction": op7_html_extraction,
    "op8_sharding": op8_sharding,
    "op9_license_scan": op9_license_scan,
    "op10_language_id": op10_language_id,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_mixing": op12_mixing,
    "op13_filter_audit": op13_filter_audit,
}

ORACLE_SQL = {
    "op8_sharding": oracle.SHARDING,
    "op11_conversation_repair": oracle.CONVERSATIONS,
    "op12_mixing": oracle.MIXING,
    "op13_filter_audit": oracle.FILTERS,
}
