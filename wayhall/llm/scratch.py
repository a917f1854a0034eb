"""Tables written to the folder the cluster shares, used to cut lineage and to compute a costly step once."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where none is set, a folder of our own in local mode, an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="wayhall-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def modest_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Lower the session's limit of rows in an Arrow batch, so that a Python worker holds few texts at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def _path(spark: SparkSession, path: str):  # noqa: ANN202
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def materialise(df: DataFrame, name: str, release: bool = False) -> DataFrame:
    """Write df as Parquet under the shared folder and read it back.

    Executors that are lost later cost nothing, as the files don't live with them. The folder is deleted when the
    driver's JVM ends, or by discard(). release asks Spark to delete the shuffle files of what has been written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = StructType.fromJson(df.schema.jsonValue())
    df.write.parquet(path)
    target, fs = _path(spark, path)
    fs.deleteOnExit(target)
    if release:
        del df  # Spark keeps shuffle files while anything refers to the plan
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.4)  # what the first has freed holds the rest
        spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(schema).parquet(path)
    out.scratch_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table of materialise() that nothing will read again."""
    target, fs = _path(df.sparkSession, df.scratch_path)
    fs.delete(target, True)
