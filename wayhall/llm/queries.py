"""Registered queries of the subpackage and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from wayhall.llm import exact_dedup, fingerprint, jaccard_join, license_scan, lm_scoring, merkle, mixing, packing, quality, simhash, substring_dedup, toxicity, vector_codes

Query = Callable[[SparkSession, str], DataFrame]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(documents(spark, sf_dir))
    return mixed.select("doc_id", "source", "copy", F.round("rate", 6).alias("rate"), "shuffle_key", F.char_length("text").cast("long").alias("n_code_points"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.lm_scores(documents(spark, sf_dir))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), labels(spark, sf_dir))


def grade() -> Column:
    """Grades of the ratings: 0 for poor text, 1 for good text that is toxic, 2 for good text."""
    return F.col("quality") * (2 - F.coalesce("toxic", F.lit(0)))


KEEP_FROM, KEEP_AT = 1.0, 0.5


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = quality.fit_quality(documents(spark, sf_dir), labels(spark, sf_dir), grade())
    return quality.score_quality(documents(spark, sf_dir), model, ["doc_id"], KEEP_FROM, KEEP_AT)


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(documents(spark, sf_dir))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(documents(spark, sf_dir))


def op8_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(documents(spark, sf_dir)).drop("spans")


def op10_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_documents(documents(spark, sf_dir))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.merkle_proofs(documents(spark, sf_dir), claimed=merkle.tampered_leaf())


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(documents(spark, sf_dir))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_exact_dedup, op2_lm_scoring, op3_toxicity, op4_quality, op5_jaccard_join, op6_substring_dedup, op7_mix_sources, op8_pack_documents, op9_license_scan, op10_fingerprint, op11_merkle_manifest, op12_simhash, op13_vector_codes)}


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": exact_dedup.ORACLE, "op5_jaccard_join": jaccard_join.ORACLE, "op6_substring_dedup": substring_dedup.ORACLE, "op7_mix_sources": mixing.oracle(), "op11_merkle_manifest": merkle.ORACLE, "op13_vector_codes": vector_codes.oracle()}
