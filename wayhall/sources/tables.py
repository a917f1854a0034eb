"""Building tables as Parquet, and files of models that were uploaded."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayhall import schema


@dataclass
class Building:
    """The tables of one or many models, keyed by model_id."""

    elements: DataFrame
    vertices: DataFrame
    rel_fills: DataFrame
    rel_voids: DataFrame
    rel_boundary: DataFrame
    rel_aggregates: DataFrame

    def only(self, model_id: str) -> Building:
        """One model's rows; the filter reaches the scan."""
        return Building(**{k: df.where(F.col("model_id") == model_id) for k, df in vars(self).items()})


def read_building(spark: SparkSession, path: str) -> Building:
    """Tables below path, each with its fixed schema; partition folders by model_id are pruned."""
    return Building(**{k: spark.read.schema(s).parquet(f"{path}/{k}") for k, s in schema.TABLES.items()})


def write_building(building: Building, path: str) -> None:
    for k, df in vars(building).items():
        df.write.mode("append").partitionBy("model_id").parquet(f"{path}/{k}")


def empty_building(spark: SparkSession) -> Building:
    return Building(**{k: spark.createDataFrame([], s) for k, s in schema.TABLES.items()})


def scan(elements: DataFrame, *classes: str) -> DataFrame:
    """All elements of the classes and of those derived from them; an unknown class has none."""
    names = sorted({n for c in classes for n in schema.SUBTYPES.get(c, (c,))})
    return elements.where(F.col("ifc_class").isin(*names))


def model_files(spark: SparkSession, path: str, read_content: bool = False) -> DataFrame:
    """file, stem, model_id and size of the models below path; names must end in .ifc, in any case, or it raises ValueError."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    rows = files.select(name.alias("file"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), F.col("length").alias("size"), *(["content"] if read_content else []))
    bad = rows.where(~F.lower("file").endswith(".ifc")).select("file").limit(1).collect()
    if bad:
        raise ValueError(f"not an .ifc file: {bad[0][0]}")
    return rows.withColumn("model_id", F.uuid())


def require_model(building: Building, model_id: str) -> Building:
    """The model's tables; LookupError if nothing is known of it."""
    own = building.only(model_id)
    if own.elements.limit(1).isEmpty():
        raise LookupError(f"unknown model: {model_id}")
    return own
