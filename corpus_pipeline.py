"""The corpus pipeline: five stages of the operators in wayhall.llm, each reading what the one before has kept.

A stage takes (spark, docs, sf_dir). All but the last return the columns of docs; the last returns packed pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from wayhall.llm import exact_dedup, jaccard_join, mixing, packing, quality
from wayhall.llm.queries import KEEP_AT, KEEP_FROM, grade
from wayhall.llm.scratch import materialise

MAX_LEN, END_ID, MIX_SEED = 4096, 2, 7


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.select_quality(docs, labels, grade(), KEEP_FROM, KEEP_AT)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the smallest id, of each group that links of 0.8 or more connect."""
    return jaccard_join.keep_one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All sources at the same weight, as many documents as come in on average, in global shuffled order."""
    return mixing.mixed_rows(docs, seed=MIX_SEED)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces in sequences of at most MAX_LEN ids."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), MAX_LEN, END_ID)


STAGES = [("quality classifier", keep_quality), ("exact dedup", drop_copies), ("near-duplicates", drop_near_copies), ("mixing", mix), ("packing", pack)]

#: Neither the classifier nor the tokenizer is SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = materialise(docs, f"stage{at}", release=True)
    return docs
