"""Queries of this subpackage: thin applications of each operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import public_tokenizers

from quarry.llm import chunk_dedup, decontaminate, divergence, filter_audit, lang_id, lm_scoring, packing, sharding, simhash, suffix_dedup, token_store, toxicity, transport_stream


def _table(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir), _table(spark, sf_dir, "benchmark"))


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.round_trip(_table(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op4_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_dedup.repeated_runs(_table(spark, sf_dir)).drop("doc_hash", "duplicates")


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir))
    return found.select("doc_id", simhash.hex_print("print").alias("fingerprint"), "component_id")


def op6_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transport_stream.document_features(_table(spark, sf_dir))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_documents(_table(spark, sf_dir))


def op8_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(_table(spark, sf_dir))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.predictions(_table(spark, sf_dir))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(_table(spark, sf_dir))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir), _table(spark, sf_dir, "labels"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.predictions(_table(spark, sf_dir), _table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_best_fit_packing": op1_best_fit_packing,
        "op2_benchmark_decontamination": op2_benchmark_decontamination,
        "op3_token_store": op3_token_store,
        "op4_chunk_dedup": op4_chunk_dedup,
        "op5_simhash_near_dedup": op5_simhash_near_dedup,
        "op6_transport_stream": op6_transport_stream,
        "op7_lm_scoring": op7_lm_scoring,
        "op8_hash_tree_sharding": op8_hash_tree_sharding,
        "op9_suffix_array_dedup": op9_suffix_array_dedup,
        "op10_language_id": op10_language_id,
        "op11_source_divergence": op11_source_divergence,
        "op12_filter_audit": op12_filter_audit,
        "op13_toxicity": op13_toxicity,
    }


def oracle_sql() -> dict[str, str]:
    """The other operators have none: tests hold them against brute force, plain versions or held-out accuracy."""
    return {"op11_source_divergence": divergence.SQL, "op12_filter_audit": filter_audit.SQL}
