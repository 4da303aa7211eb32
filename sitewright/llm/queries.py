"""Registered queries of the training-data operators: production parameters, whole tables, full results."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sitewright.llm import archives, centroid_clusters, decontamination, languages, mixing, near_duplicates, neighbours, oracles, quality, substrings, token_counts, toxicity, vector_codes, word_codec
from sitewright.llm.tables import load


def mixing_weights(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.report(load(spark, folder, "documents"))


def substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.removal_report(load(spark, folder, "documents"))


def benchmark_hits(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.report(load(spark, folder, "documents"), load(spark, folder, "benchmark"))


def token_count(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.count_tokens(load(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


def toxicity_grades(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.report(load(spark, folder, "documents"), load(spark, folder, "labels"))


def near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.report(load(spark, folder, "documents"), percent=85)


def warc_revisits(spark: SparkSession, folder: str) -> DataFrame:
    return archives.report(load(spark, folder, "pages"))


def nearest_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.nearest(load(spark, folder, "embeddings"), k=20, query_every=20)


def language_id(spark: SparkSession, folder: str) -> DataFrame:
    return languages.classify(load(spark, folder, "documents"), load(spark, folder, "pages"))


def quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.report(load(spark, folder, "documents"), load(spark, folder, "labels"))


def compressed_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return vector_codes.report(load(spark, folder, "embeddings"), parts=8, entries=16, rounds=6, scale=4096)


def byte_pair_codec(spark: SparkSession, folder: str) -> DataFrame:
    return word_codec.report(load(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def clustered_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return centroid_clusters.report(load(spark, folder, "embeddings"), clusters=8, rounds=10, width=64, scale=1024, seed=3)


QUERIES = {
    "op1_mixing": mixing_weights,
    "op2_substring_dedup": substring_dedup,
    "op3_decontamination": benchmark_hits,
    "op4_token_count": token_count,
    "op5_nearest_vectors": nearest_vectors,
    "op6_toxicity": toxicity_grades,
    "op7_near_dedup": near_dedup,
    "op8_warc": warc_revisits,
    "op9_language_id": language_id,
    "op10_quality": quality_rules,
    "op11_vector_codes": compressed_vectors,
    "op12_word_codec": byte_pair_codec,
    "op13_centroid_clusters": clustered_vectors,
}

#: DuckDB texts where SQL can express the result; the others are tested against brute force.
ORACLE: dict[str, str] = {
    "op1_mixing": mixing.ORACLE,
    "op2_substring_dedup": oracles.SUBSTRINGS,
    "op3_decontamination": oracles.DECONTAMINATION,
    "op7_near_dedup": oracles.NEAR_DUPLICATES,
    "op8_warc": archives.ORACLE,
    "op11_vector_codes": oracles.vector_codes(),
    "op13_centroid_clusters": oracles.centroid_clusters(),
}
