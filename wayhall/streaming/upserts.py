"""Upserts while rows arrive: the last write of each key wins, whatever order rows come in and however often."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

def latest(rows: DataFrame, keys: list[str], order: str, body_cols: list[str]) -> DataFrame:
    """keys, last, first, body of a stream: rows again whenever their key has been written.

    A write's place is its order (long, one write for each place of a key); body is its other columns as JSON. State is
    one row for each key; the writes of a batch are joined to one for each key before they are shuffled. Rows of null order are left out.
    """
    body = F.to_json(F.struct(*body_cols), {"ignoreNullFields": "false"})
    told = rows.where(F.col(order).isNotNull()).select(*keys, F.col(order).cast("long").alias("ord"), body.alias("body"))
    return told.groupBy(*keys).agg(F.max("ord").alias("last"), F.min("ord").alias("first"), F.max_by("body", "ord").alias("body"))


def upsert_on_arrival(rows: DataFrame, keys: list[str], order: str, body_cols: list[str], out: str, checkpoint: str) -> StreamingQuery:
    """Write what changes in each micro-batch below out, until all that is there has been read.

    A batch that is repeated after a failure overwrites its own folder, so nothing is counted twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    found = latest(rows, keys, order, body_cols)
    return found.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, out: str, keys: list[str], body_schema: str) -> DataFrame:
    """keys, seq and the body's columns: the state of all keys after the batches below out."""
    found = spark.read.parquet(out).groupBy(*keys).agg(F.max_by(F.struct("last", "first", "body"), F.struct("last", "batch")).alias("s"), F.min("first").alias("seq"))
    return found.select(*keys, "seq", F.from_json("s.body", body_schema).alias("__body")).select(*keys, "seq", "__body.*")


EDGE_KEY, EDGE_BODY = ["model_id", "a", "b"], "edge_type string, weight double, accessible boolean, coords array<struct<x:double,y:double,z:double>>"


def arriving_edges(rows: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Edge rows as of operators.graph.upsert_edges() (model_id, a, b, ord ..), as they arrive in a stream."""
    rows = rows.where(F.size("coords") >= 2).withColumns({"a": F.least("a", "b"), "b": F.greatest("a", "b")})
    return upsert_on_arrival(rows, EDGE_KEY, "ord", [c.split()[0] for c in EDGE_BODY.split(", ")], out, checkpoint)


def current_edges(spark: SparkSession, out: str) -> DataFrame:
    """model_id, a, b, seq, edge_type, weight, accessible, coords: what upsert_edges() gives for all rows that have arrived."""
    return current(spark, out, EDGE_KEY, EDGE_BODY)
