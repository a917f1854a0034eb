"""Blocks of neighbouring ids, of about equal numbers of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def id_cuts(docs: DataFrame, id_col: str, blocks: int, weight: Column | None = None) -> list:
    """At most blocks - 1 bounds, approximate quantiles of the ids; weight: how many times (a whole number) each row counts."""
    share = [i / blocks for i in range(1, blocks)]
    docs = docs.select(id_col) if weight is None else docs.select(F.explode(F.array_repeat(F.col(id_col), weight)).alias(id_col))
    found = docs.agg(F.percentile_approx(id_col, share, 10 * blocks)).first()[0] if share else None
    return sorted(set(found or []))


def block_of(ident: Column, cuts: list) -> Column:
    """How many of the sorted cuts are at most ident, by binary search in a literal; null ids belong to the last block."""
    table, n = F.array(*(F.lit(c) for c in cuts)), len(cuts)
    powers = F.array(*(F.lit(1 << k) for k in range(max(1, n).bit_length() - 1, -1, -1)))
    step = lambda at, p: F.when((at + p <= n) & (F.get(table, at + p - 1) <= ident), at + p).otherwise(at)
    return F.when(ident.isNull(), F.lit(n)).otherwise(F.aggregate(powers, F.lit(0), step)) if n else F.lit(0)


