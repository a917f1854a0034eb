"""Connected components of an edge table by alternating large and small stars, wholly on the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayhall.llm.scratch import discard, materialise


def _settled(edges: DataFrame) -> bool:
    """Whether edges (u, v) are stars: no node on both sides, no v twice."""
    sides = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(0).alias("low")), F.struct(F.col("v").alias("node"), F.lit(1).alias("low")))).alias("s")).select("s.*")
    seen = sides.groupBy("node").agg(F.sum("low").alias("below"), F.count(F.lit(1)).alias("n"))
    return seen.where((F.col("below") > 1) | ((F.col("below") > 0) & (F.col("n") > F.col("below")))).isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """node, root: each node of edges (u, v longs) with the smallest node of its component.

    A node's smallest neighbour is found with map-side combining and joined back, so a node with very many neighbours
    isn't gathered in one task.
    """
    now = materialise(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    while not _settled(now):
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("m").alias("u"), "v").where("u <> v").distinct()
        large = materialise(large, "large")
        low = large.groupBy(F.col("v").alias("w")).agg(F.min("u").alias("m"))
        joined = large.withColumnRenamed("v", "w").join(low, "w")
        small = joined.select(F.col("m").alias("u"), F.explode(F.array("u", "w")).alias("v")).where("u <> v").distinct()
        small = materialise(small, "small")
        discard(now)
        discard(large)
        now = small
    return now.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(now.select(F.col("u").alias("node"), F.col("u").alias("root"))).distinct()
