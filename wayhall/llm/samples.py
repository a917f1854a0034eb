"""Bounded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_col: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null ids have none."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(c.cast("string").cast("binary")) % n


def labelled_sample(docs: DataFrame, labels: DataFrame, label: Column, max_rows: int, where: Column | None = None, seed: int = 3) -> DataFrame:
    """text and label of at most max_rows labelled rows, the first by a hash of their id; rows without id or label don't count.

    The sampled ids are bounded by max_rows, so they may be sent to all executors and documents aren't shuffled.
    """
    have = labels.select("doc_id", label.cast("double").alias("label")).where("doc_id IS NOT NULL AND label IS NOT NULL")
    have = have.where(where) if where is not None else have
    picked = have.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(max_rows)
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id").select("text", "label")
