"""Doors: accessibility, host walls, frames, and links to areas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayhall.functions.geometry import at_height, box_distance_2d, in_box_2d, path_from_door, point, principal_axis
from wayhall.functions.text import or_default
from wayhall.operators.areas import placed
from wayhall.operators.base import KEY, of_elements, ordinal
from wayhall.plans.checkpoint import dealt
from wayhall.plans.spatial import first_k, first_of, near_boxes
from wayhall.schema import BARRIER, DOOR, DOOR_AREA, DOOR_NAME, WALLS
from wayhall.sources.tables import scan

NARROWEST, AT_DOOR, NEAR_DOOR, AREAS_PER_DOOR, LOW_SLICE = 0.85, 0.65, 1.10, 2, 0.40


def wide_enough(width: Column) -> Column:
    """Doors of unknown (0) width count as wide enough."""
    return F.when(width > 0, width >= NARROWEST).otherwise(F.lit(True))


def host_walls(rel_fills: DataFrame, rel_voids: DataFrame, elements: DataFrame) -> DataFrame:
    """model_id, element_id, wall_id: the first wall whose opening each element fills."""
    walls = elements.where(F.col("ifc_class").isin(*WALLS)).select("model_id", F.col("element_id").alias("wall_id")).distinct()
    hosts = rel_fills.select("model_id", "element_id", "opening_id", F.col("seq").alias("fill")).join(
        rel_voids.select("model_id", "opening_id", "wall_id", F.col("seq").alias("void")), ["model_id", "opening_id"]
    )
    return first_of(hosts.join(walls, ["model_id", "wall_id"], "left_semi"), KEY, [F.col("fill"), F.col("void")]).select(*KEY, "wall_id")


def mesh_axes(vertices: DataFrame, low: float = LOW_SLICE) -> DataFrame:
    """model_id, element_id, axis: main direction of the vertices near the base, or of all if fewer than two are; else x.

    Scatter matrices are centred moments of places counted from the element's own corner, so that they stay exact far from
    the origin. The vertices are dealt once, by element, in partitions that don't grow with the table.
    """
    own = Window.partitionBy(*KEY)
    vertices = dealt(vertices, *KEY).select(*KEY, *"xyz", *(F.min(c).over(own).alias(f"min_{c}") for c in "xyz"))
    x, y, near_base = F.col("x") - F.col("min_x"), F.col("y") - F.col("min_y"), F.col("z") <= F.col("min_z") + low
    parts = {}
    for name, a, b in (("all", x, y), ("low", F.when(near_base, x), F.when(near_base, y))):
        parts |= {f"{name}_n": F.count(a), f"{name}_xx": F.regr_sxx(b, a), f"{name}_yy": F.regr_syy(b, a), f"{name}_xy": F.regr_sxy(b, a)}
    found = vertices.groupBy(*KEY).agg(*(v.alias(k) for k, v in parts.items()))
    moment = lambda m: F.when(F.col("low_n") >= 2, F.col(f"low_{m}")).otherwise(F.col(f"all_{m}"))
    axis = principal_axis(moment("n"), moment("xx"), moment("yy"), moment("xy"))
    return found.select(*KEY, F.coalesce(axis, point(F.lit(1.0), F.lit(0.0))).alias("axis"))


def doors(elements: DataFrame, geo: DataFrame, levels: DataFrame, vertices: DataFrame, rel_fills: DataFrame, rel_voids: DataFrame) -> DataFrame:
    """model_id, id, name, level, x, y, z, width, accessible, axis, normal, ord. A host wall without mesh has axis x."""
    own = placed(scan(elements, "IfcDoor"), geo, levels)
    hosted = own.join(host_walls(rel_fills, rel_voids, elements), KEY, "left")
    framed = hosted.withColumn("shape_id", F.coalesce("wall_id", "element_id"))
    needed = framed.select("model_id", F.col("shape_id").alias("element_id")).distinct()
    axes = mesh_axes(of_elements(vertices, needed)).select("model_id", F.col("element_id").alias("shape_id"), "axis")
    framed = framed.join(axes, ["model_id", "shape_id"], "left").withColumn("axis", F.coalesce("axis", point(F.lit(1.0), F.lit(0.0))))
    width = F.coalesce("overall_width", F.lit(0.0))
    return framed.select(
        "model_id", F.col("element_id").alias("id"), or_default(F.col("name"), DOOR_NAME).alias("name"), "level",
        F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("floor").alias("z"), width.alias("width"), wide_enough(width).alias("accessible"),
        "axis", point(-F.col("axis.y"), F.col("axis.x")).alias("normal"), ordinal(DOOR, F.col("seq")).alias("ord"),
    )


def door_areas(doors: DataFrame, areas: DataFrame) -> DataFrame:
    """Columns of doors and area_id, area_x, area_y, d, rank: the up to two nearest areas on the door's level.

    An area whose box is within 0.65 of the door in both coordinates is at distance 0; others count up to 1.10 away.
    Doors of one place have the same areas, which are looked for once.
    """
    boxes = areas.select("model_id", "level", F.col("id").alias("area_id"), F.col("x").alias("area_x"), F.col("y").alias("area_y"), F.col("ord").alias("area_ord"), "min_x", "min_y", "max_x", "max_y")
    spot = ["model_id", "level", "x", "y"]
    near = near_boxes(doors.select(*spot).distinct(), boxes, ["model_id", "level"], NEAR_DOOR)
    x, y = F.col("x"), F.col("y")
    near = near.withColumn("d", F.when(in_box_2d(x, y, "", AT_DOOR), F.lit(0.0)).otherwise(box_distance_2d(x, y, ""))).where(F.col("d") <= NEAR_DOOR)
    found = first_k(near, spot, [F.col("d"), F.col("area_ord")], AREAS_PER_DOOR).select(*spot, "area_id", "area_x", "area_y", "area_ord", "d", "rank")
    return doors.join(found, spot)


def door_edges(linked: DataFrame) -> DataFrame:
    """Edges from door_areas()."""
    path = path_from_door(point(F.col("x"), F.col("y")), point(F.col("area_x"), F.col("area_y")), F.col("normal"))
    return linked.select(
        "model_id", F.col("id").alias("a"), F.col("area_id").alias("b"), F.lit(DOOR_AREA).alias("edge_type"),
        F.when(F.col("accessible"), 1.0).otherwise(BARRIER).alias("weight"), "accessible", at_height(path, F.col("z")).alias("coords"),
        (F.col("ord") + F.col("rank")).alias("ord"),
    )
