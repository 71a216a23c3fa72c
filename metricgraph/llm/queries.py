"""The registered queries of this subpackage: one for each operator, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metricgraph.llm import decontaminate, fingerprints, lines, near, products, quality, ranking, resampling, shards, suffixes, tokens, toxicity
from metricgraph.llm.common import table, vocabulary_path


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode(table(spark, sf_dir, "documents"), vocabulary_path(), digests=True)


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near.near_duplicates(table(spark, sf_dir, "documents"), shingle=2, percent=80)
    return found.select("doc_id", "n_shingles", F.col("component").alias("component_id"), "kept")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_report(table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.suffix_report(table(spark, sf_dir, "documents"))


def op5_id_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.round_trip(table(spark, sf_dir, "documents"), vocabulary_path())


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.against_edits(table(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), vocabulary_path())


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return products.top_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_bpe_round_trip, op2_near_duplicates, op3_line_dedup, op4_suffix_dedup, op5_id_shards, op6_fingerprints, op7_decontaminate, op8_toxicity, op9_token_counts, op10_quality, op11_resampling, op12_top_products, op13_ranked_search)}
