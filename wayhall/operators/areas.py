"""Walkable areas: rooms, and small slabs that lie in no room and in no slab accepted before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayhall.functions.geometry import in_box_3d
from wayhall.functions.text import NOT_FLOOR_TYPES, or_default, type_name
from wayhall.operators.base import KEY, ordinal
from wayhall.plans.checkpoint import cut
from wayhall.plans.ordered import settled
from wayhall.plans.spatial import in_some_box, nearest_storey
from wayhall.schema import ROOM, ROOM_NAME, SLAB, SLAB_NAME
from wayhall.sources.tables import scan

LARGEST_SLAB, INSIDE = 10.0, 0.10
#: Side of the squares in which slabs are looked up.
LOOKUP = 4.0
BOX = [f"{m}_{c}" for m in ("min", "max") for c in "xyz"]


def placed(elements: DataFrame, geo: DataFrame, levels: DataFrame) -> DataFrame:
    """Elements with geometry, and the storey nearest to their base as level and floor."""
    snapped = elements.join(geo, KEY).join(levels, "model_id").withColumn("__s", nearest_storey(F.col("min_z")))
    return snapped.withColumns({"level": F.col("__s.name"), "floor": F.col("__s.elevation")}).drop("__s", "storeys")


def candidate_slabs(slabs: DataFrame) -> DataFrame:
    """Neither of an excluded type nor larger than 10 in both directions; a missing type is kept."""
    large = (F.col("max_x") - F.col("min_x") > LARGEST_SLAB) & (F.col("max_y") - F.col("min_y") > LARGEST_SLAB)
    return slabs.where(~type_name(F.col("predefined_type")).isin(*NOT_FLOOR_TYPES) & ~large)


def _outside(slabs: DataFrame, rooms: DataFrame) -> DataFrame:
    """Slabs whose centroid lies in no room, tolerance included; the search for one ends at the first."""
    spots = slabs.select(*KEY, F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("cz").alias("z"))
    inside = in_box_3d(F.col("x"), F.col("y"), F.col("z"), "", INSIDE)
    return slabs.join(in_some_box(spots, rooms.select("model_id", *BOX), ["model_id"], INSIDE, inside).select(*KEY).distinct(), KEY, "left_anti")


def free_slabs(slabs: DataFrame, rooms: DataFrame) -> DataFrame:
    """Slabs whose centroid lies in no room, nor in an earlier slab that is itself kept."""
    outside = cut(_outside(slabs, rooms))
    wide = {f"{m}_{c}": F.col(f"{m}_{c}") + r for m, r in (("min", -INSIDE), ("max", INSIDE)) for c in "xyz"}
    spots = outside.select("model_id", F.col("element_id").alias("id"), F.col("seq").alias("order"), *(F.col(f"c{c}").alias(c) for c in "xyz"), *BOX).withColumns(wide)
    out = settled(spots, LOOKUP).where("NOT kept").select("model_id", F.col("id").alias("element_id"))
    return outside.join(out, KEY, "left_anti")


def areas(elements: DataFrame, geo: DataFrame, levels: DataFrame) -> DataFrame:
    """model_id, id, type, name, level, x, y, z, ord, min_x .. max_z; ord is the scan order, rooms first."""
    rooms = placed(scan(elements, "IfcSpace"), geo, levels)
    slabs = free_slabs(candidate_slabs(placed(scan(elements, "IfcSlab"), geo, levels)), rooms)
    shape = lambda df, kind, name: df.select(
        "model_id", F.col("element_id").alias("id"), F.lit(kind).alias("type"), or_default(F.col("name"), name).alias("name"), "level",
        F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("floor").alias("z"), ordinal(kind, F.col("seq")).alias("ord"), *BOX,
    )
    return shape(rooms, ROOM, ROOM_NAME).unionByName(shape(slabs, SLAB, SLAB_NAME))
