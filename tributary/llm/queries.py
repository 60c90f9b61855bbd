"""One query per operator, each over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tributary.llm import bpe, filter_audit, language, licenses, merkle, metric_search, multi_index, near_dedup, packing, pii, pitman_yor, quality, sql, toxicity
from tributary.llm.common import table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op2_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score_documents(table(spark, sf_dir, "documents"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_search.top_inner_products(table(spark, sf_dir, "embeddings"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify_pages(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), output="digests")


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.approximate_neighbours(table(spark, sf_dir, "embeddings"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), near_dedup.DedupParams(words=3, percent=85))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return toxicity.toxicity_scores(documents, toxicity.fit(documents, table(spark, sf_dir, "labels")))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"), merkle.tampered_fifth())


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_pitman_yor": op2_pitman_yor,
    "op3_licenses": op3_licenses,
    "op4_quality": op4_quality,
    "op5_exact_search": op5_exact_search,
    "op6_language": op6_language,
    "op7_bpe": op7_bpe,
    "op8_neighbours": op8_neighbours,
    "op9_near_dedup": op9_near_dedup,
    "op10_toxicity": op10_toxicity,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_filter_audit": op12_filter_audit,
    "op13_personal_data": op13_personal_data,
}

#: DuckDB SQL of those that SQL can express.
ORACLE_SQL: dict[str, str] = {"op5_exact_search": sql.EXACT_SEARCH, "op11_merkle_manifest": sql.merkle_manifest(), "op12_filter_audit": sql.filter_audit()}
