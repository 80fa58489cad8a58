"""The queries of the training-data operators: each applies its operator to the whole of its table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.package import shipped
from . import bpe, fingerprints, language, negatives, ngram_join, packing, quality_model, quality_rules, suffix_dedup, token_counts, toxicity, whitening, window_dedup

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return shipped(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.rules(table(spark, sf_dir, "documents")).drop("longest_repeat")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_super_k_mers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_dedup.remove_repeated_windows(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op6_threshold_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_bpe_forced_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), WORD_BPE)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), WORD_BPE)


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeated_bytes(table(spark, sf_dir, "documents"))


def relabelled(embeddings: DataFrame) -> DataFrame:
    """The labels that operator 11's query starts from: those of ids divisible by 7 move on by one."""
    label = F.col("label")
    return embeddings.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negatives(relabelled(table(spark, sf_dir, "embeddings")))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), BYTE_BPE)


QUERIES = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard_join,
        op2_quality_rules,
        op3_toxicity,
        op4_super_k_mers,
        op5_language_id,
        op6_threshold_sketch,
        op7_quality_classifier,
        op8_bpe_forced_boundaries,
        op9_best_fit_packing,
        op10_suffix_array_dedup,
        op11_hard_negatives,
        op12_embedding_whitening,
        op13_token_counts,
    )
}
SQL: dict[str, str] = {"op2_quality_rules": quality_rules.SQL, "op4_super_k_mers": window_dedup.SQL, "op11_hard_negatives": negatives.SQL}
