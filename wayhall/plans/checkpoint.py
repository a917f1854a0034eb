"""Lineage cuts of iterative plans, tables written for those that read them often, and tables dealt to as many tasks as they need."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Rows of a partition, about, where what is sorted in one task has to stay small.
ROWS = 1 << 20


def folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where none is, a folder of our own in local mode, an error on a cluster."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found and sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(found or "file://" + tempfile.mkdtemp(prefix="wayhall-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df, computed and read from folder()."""
    folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, *by: str) -> DataFrame:
    """df as a Parquet table in folder(), in partitions by the columns, deleted when the driver ends."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *by: str, rows: int = ROWS) -> DataFrame:
    """df by the columns in partitions of about so many rows, so that a task's memory doesn't grow with df; at least as many as are set."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, df.count() // rows + 1), *by)
