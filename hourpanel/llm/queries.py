"""Registered queries of this package: one per operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bloom_lm, bm25_packing, centroid_clusters, decontaminate, edit_counts, golay_simhash, line_frequency, quality_classifier, suffix_dedup, template_extraction, token_alignment, toxicity, warc_bundles
from .common import table


def op5_line_frequency_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_frequency.judge(table(spark, sf_dir, "documents"))


def op1_rare_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_edit_aware_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_counts.revised_counts(table(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(table(spark, sf_dir, "documents"))


def op4_template_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template_extraction.extract(table(spark, sf_dir, "pages"))


def op6_bm25_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25_packing.pack(table(spark, sf_dir, "documents"))


def op7_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_golay_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return golay_simhash.components(table(spark, sf_dir, "documents"))


def op9_seekable_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_bundles.round_trip(table(spark, sf_dir, "pages"))


def op10_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_equal_average_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters.cluster(table(spark, sf_dir, "embeddings"))


def op13_bloom_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloom_lm.score(table(spark, sf_dir, "documents"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.digest(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_rare_seed_decontamination": op1_rare_seed_decontamination,
    "op2_edit_aware_counts": op2_edit_aware_counts,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_template_extraction": op4_template_extraction,
    "op5_line_frequency_rules": op5_line_frequency_rules,
    "op6_bm25_packing": op6_bm25_packing,
    "op7_subword_quality": op7_subword_quality,
    "op8_golay_simhash": op8_golay_simhash,
    "op9_seekable_warc": op9_seekable_warc,
    "op10_counterfactual_toxicity": op10_counterfactual_toxicity,
    "op11_equal_average_clusters": op11_equal_average_clusters,
    "op12_token_alignment": op12_token_alignment,
    "op13_bloom_language_model": op13_bloom_language_model,
    "op11_equal_average_clusters": op11_equal_average_clusters,
    "op12_token_alignment": op12_token_alignment,
    "op13_bloom_language_model": op13_bloom_language_model,
}
ORACLE_SQL = {
    "op11_equal_average_clusters": centroid_clusters.ORACLE_SQL,
    "op5_line_frequency_rules": line_frequency.ORACLE_SQL,
    "op9_seekable_warc": warc_bundles.ORACLE_SQL,
}
