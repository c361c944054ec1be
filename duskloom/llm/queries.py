"""The registered queries of this subpackage and their SQL, each over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, embed_dedup, exact_dedup, html_extract, langid, license_scan, mixing, point_in_time, quality, resample, simhash, toxicity, url_filter
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def bpe_path(name: str = "byte_bpe_50k.json") -> str:
    """The place of a public tokenizer's vocabulary file."""
    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digests(table(spark, sf_dir, "documents"), bpe_path())


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_dedup(table(spark, sf_dir, "documents"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.source_mixing(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.embedding_dedup(table(spark, sf_dir, "embeddings"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_feature_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return point_in_time.feature_join(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


def op13_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_bpe, op2_license_scan, op3_exact_dedup, op4_language_id, op5_simhash, op6_source_mixing, op7_quality, op8_embedding_dedup, op9_url_filter, op10_toxicity, op11_feature_join, op12_html_extract, op13_importance_resample, pipeline)}
ORACLE_SQL: dict[str, str] = {"op2_license_scan": license_scan.ORACLE, "op3_exact_dedup": exact_dedup.ORACLE, "op6_source_mixing": mixing.ORACLE, "op8_embedding_dedup": embed_dedup.ORACLE, "op9_url_filter": url_filter.ORACLE, "op11_feature_join": point_in_time.ORACLE, "op12_html_extract": html_extract.ORACLE, "op13_importance_resample": resample.ORACLE}
