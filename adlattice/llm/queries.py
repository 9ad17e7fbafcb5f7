"""The registered queries of this folder: each applies an operator to whole tables of a folder of test data."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from adlattice.llm import (
    alignment,
    bpe,
    centroids,
    collisions,
    decontaminate,
    language_id,
    media,
    near_dup,
    pii,
    suffix_dedup,
    suffix_tree,
    token_ids,
    toxicity,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids.encoded_corpus(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identified(_table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removal(_table(spark, sf_dir, "documents"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.stored_texts(_table(spark, sf_dir, "documents"))


def op8_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.components(_table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return pii.find(docs, pii.disclosures(docs))


def op10_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.model_scores(_table(spark, sf_dir, "documents"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(_table(spark, sf_dir, "embeddings"))


def op12_embedding_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collisions.linked(_table(spark, sf_dir, "embeddings"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("byte_bpe_50k.json", "piece_bpe_32k.model")
    return alignment.alignments(_table(spark, sf_dir, "documents"), *map(public_tokenizers.path, names))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_ids,
        op2_language_id,
        op3_toxicity,
        op4_decontamination,
        op5_suffix_dedup,
        op6_byte_bpe,
        op7_media,
        op8_near_dup,
        op9_pii,
        op10_suffix_tree,
        op11_centroid_clustering,
        op12_embedding_near_dup,
        op13_token_alignment,
    )
} | {"pipeline": corpus_pipeline.run}

#: The other results can't be stated in the test database's SQL; tests/llm compares them with brute force.
ORACLE_SQL: dict[str, str] = {"op11_centroid_clustering": centroids.cluster_sql()}
