"""Graphs of models whose tables arrive as files: each micro-batch builds the models that are new in it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from wayhall.api import build_graph
from wayhall.sources.tables import Building, read_building


def build_on_arrival(spark: SparkSession, tables: str, arrivals: str, out: str, checkpoint: str) -> StreamingQuery:
    """Watch arrivals (JSON lines with model_id, written once a model's tables are complete) and write graphs below out.

    A model's partitions are overwritten when it arrives again, so a batch that is repeated after a failure changes nothing.
    """

    def build(batch: DataFrame, _: int) -> None:
        new = batch.select("model_id").where("model_id IS NOT NULL").distinct()
        all_ = read_building(batch.sparkSession, tables)
        own = Building(**{k: df.join(new, "model_id", "left_semi") for k, df in vars(all_).items()})
        for k, df in vars(build_graph(own)).items():
            df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model_id").parquet(f"{out}/{k}")

    found = spark.readStream.schema("model_id string").json(arrivals)
    return found.writeStream.foreachBatch(build).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
