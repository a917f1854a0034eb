"""Element geometry and storeys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayhall.functions.text import or_default, stripped
from wayhall.schema import ONLY_STOREY, STAGES, UNKNOWN_STOREY
from wayhall.sources.tables import scan

KEY = ["model_id", "element_id"]


def ordinal(stage: str, seq: Column, sub: Column | int = 0) -> Column:
    """Position of a node or edge among all of its model: stage, element, place in the element."""
    sub = F.lit(sub) if isinstance(sub, int) else sub
    return F.lit(STAGES[stage] << 52) + seq.cast("long") * 4096 + sub.cast("long")


def geometry(vertices: DataFrame) -> DataFrame:
    """Mean and bounds of each element's vertices; elements without vertices have no row."""
    bounds = (f(c).alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in "xyz")
    return vertices.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_vertices"), *(F.avg(c).alias(f"c{c}") for c in "xyz"), *bounds)


def of_elements(vertices: DataFrame, wanted: DataFrame) -> DataFrame:
    """The vertices of the elements wanted (model_id, element_id).

    No semi-join: where vertices are a union of tables Spark moves that into each of them, and computes what is wanted for each.
    """
    return vertices.join(wanted.select(*KEY).distinct(), KEY)


def of_kinds(vertices: DataFrame, wanted: list[DataFrame]) -> DataFrame:
    """The vertices of elements that some of the tables name (model_id, element_id), and kinds: a bit for each table that does."""
    told = wanted[0].select(*KEY, F.lit(1).alias("kind"))
    for k, w in enumerate(wanted[1:], 1):
        told = told.unionByName(w.select(*KEY, F.lit(1 << k).alias("kind")))
    return vertices.join(told.groupBy(*KEY).agg(F.bit_or("kind").alias("kinds")), KEY)


def storeys(elements: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """model_id, name, elevation, seq. Of storeys with one name the first gives the place, the last the elevation.

    Missing or unreadable elevations are 0; models without storeys get one at 0. every has a row of each model, if elements may not.
    """
    found = scan(elements, "IfcBuildingStorey").select(
        "model_id", "seq", stripped(or_default(F.col("name"), UNKNOWN_STOREY)).alias("name"),
        F.coalesce(F.expr("try_cast(elevation AS double)"), F.lit(0.0)).alias("elevation"),
    )
    named = found.groupBy("model_id", "name").agg(F.max_by("elevation", "seq").alias("elevation"), F.min("seq").alias("seq"))
    bare = (elements if every is None else every).select("model_id").distinct().join(named, "model_id", "left_anti")
    return named.unionByName(bare.select("model_id", F.lit(ONLY_STOREY).alias("name"), F.lit(0.0).alias("elevation"), F.lit(0).cast("long").alias("seq")))


def first_scan(elements: DataFrame) -> DataFrame:
    """The first row of each element id."""
    own = Window.partitionBy(*KEY).orderBy("seq")
    return elements.withColumn("__n", F.row_number().over(own)).where("__n = 1").drop("__n")
