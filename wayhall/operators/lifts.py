"""Lifts: which transport elements are one, cabins grouped to shafts, nodes and edges by storey."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayhall.functions.geometry import box_distance_2d, distance_2d, point, straight
from wayhall.functions.text import NOT_LIFT_TYPES, is_lift_by_text, type_name
from wayhall.operators.base import KEY, first_scan, ordinal
from wayhall.operators.verticals import DOOR_REACH, SPOT, _edge, doors_at, to_area_edges, to_door_edges
from wayhall.plans.checkpoint import cut, written
from wayhall.plans.ordered import settled
from wayhall.plans.spatial import first_of, near_boxes, near_points, touched_storeys
from wayhall.schema import LIFT, LIFT_EDGE, LIFT_NAME
from wayhall.sources.tables import scan

STOREY_REACH, DOOR_HIT, SHAFT, AREA_REACH, DOORS_PER_LEVEL = 0.50, 5.0, 2.0, 2.5, 2
#: Least and most width, least height: for lifts by text, and for others.
SIZES = {True: (0.60, 8.00, 1.00), False: (0.80, 6.00, 2.20)}


def sized(semantic: Column, dx: Column, dy: Column, dz: Column) -> Column:
    """Whether the extents fit a lift."""
    fits = lambda s: dx.between(s[0], s[1]) & dy.between(s[0], s[1]) & (dz >= s[2])
    return F.when(semantic, fits(SIZES[True])).otherwise(fits(SIZES[False]))


def transports(elements: DataFrame, geo: DataFrame, levels: DataFrame) -> DataFrame:
    """Transport elements of a lift's type and size that touch a storey: semantic, touched (storeys by elevation)."""
    found = first_scan(scan(elements, "IfcTransportElement")).where(~type_name(F.col("predefined_type"), strip=True).isin(*NOT_LIFT_TYPES))
    found = found.withColumn("semantic", is_lift_by_text(F.col("predefined_type"), F.col("name"), F.col("object_type"), F.col("description")))
    found = found.join(geo, KEY).join(levels, "model_id").withColumn("touched", touched_storeys(F.col("min_z"), F.col("max_z"), STOREY_REACH))
    extent = [F.col(f"max_{c}") - F.col(f"min_{c}") for c in "xyz"]
    return found.where(sized(F.col("semantic"), *extent) & (F.size("touched") > 0)).select(*KEY, "seq", "semantic", "cx", "cy", "touched")


def door_hits(found: DataFrame, doors: DataFrame) -> DataFrame:
    """model_id, element_id, hits: on how many touched storeys a door is within 5.0."""
    spots = found.select(*KEY, F.col("cx").alias("x"), F.col("cy").alias("y"), F.explode("touched.name").alias("level"))
    # By places: of those with a door near all elements have one.
    near = near_points(spots.select(*SPOT).distinct(), doors.select(*SPOT).distinct(), ["model_id", "level"], DOOR_HIT)
    hit = near.where(distance_2d(F.col("x"), F.col("y"), F.col("r_x"), F.col("r_y")) <= DOOR_HIT).select(*SPOT).distinct()
    return spots.join(hit, SPOT).groupBy(*KEY).agg(F.count_distinct("level").alias("hits"))


def shafts(cabins: DataFrame) -> DataFrame:
    """model_id, element_id, leader: cabins join the first group, in scan order, whose first cabin is within 2.0.

    Cabins of one place all follow what the first of them does, so the pass runs over places.
    """
    spots = cabins.select(*KEY, F.col("seq").alias("order"), F.col("cx").alias("x"), F.col("cy").alias("y"))
    spot = ["model_id", "x", "y"]
    places = spots.groupBy(*spot).agg(F.min_by("element_id", F.struct("order", "element_id")).alias("id"), F.min("order").alias("order"))
    sides = {f"{m}_{c}": F.col(c) + r for m, r in (("min", -SHAFT), ("max", SHAFT)) for c in "xy"}
    flat = {k: F.lit(0.0) for k in ("z", "min_z", "max_z")}
    made = settled(places.select("model_id", "id", "order", "x", "y").withColumns(sides | flat), SHAFT, SHAFT)
    led = places.select(*spot, "id", F.col("order").alias("first")).join(made, ["model_id", "id"]).select(
        *(F.col(c).alias(f"p_{c}") for c in spot), "first", F.col("kept").alias("leads"), F.coalesce("by", "id").alias("leader"))
    found = spots.join(led, [F.col(c).eqNullSafe(F.col(f"p_{c}")) for c in spot])
    own = F.col("leads") & (F.col("order") <= F.col("first"))
    return found.select(*KEY, F.when(F.coalesce(own, F.lit(True)), F.col("element_id")).otherwise(F.col("leader")).alias("leader"))


def lifts(elements: DataFrame, geo: DataFrame, levels: DataFrame, doors: DataFrame) -> DataFrame:
    """model_id, element_id, x, y, ord, touched: lifts of two storeys or more.

    Elements that touch several storeys are lifts by text or with a door near; those of one storey only as a shaft.
    """
    found = cut(transports(elements, geo, levels))
    tall = found.where(F.size("touched") >= 2)
    hits = door_hits(tall.where(~F.col("semantic")), doors)
    tall = tall.where("semantic").unionByName(tall.where(~F.col("semantic")).join(hits, KEY, "left_semi"))
    single = tall.select(*KEY, F.col("cx").alias("x"), F.col("cy").alias("y"), ordinal(LIFT, F.col("seq")).alias("ord"), "touched")
    cabins = found.where((F.size("touched") == 1) & F.col("semantic"))
    grouped = cabins.join(shafts(cabins), KEY).groupBy("model_id", "leader").agg(
        F.avg("cx").alias("x"), F.avg("cy").alias("y"), F.min("seq").alias("seq"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("touched")))).alias("touched"),
    )
    grouped = grouped.where(F.size("touched") >= 2).select("model_id", F.col("leader").alias("element_id"), "x", "y", ordinal("cabins", F.col("seq")).alias("ord"), "touched")
    return single.unionByName(grouped)


def lift_nodes(found: DataFrame) -> DataFrame:
    """A node for each storey of each lift; pos is its place among them."""
    rows = found.select("model_id", "element_id", "x", "y", "ord", F.posexplode("touched").alias("pos", "storey"))
    return rows.select(
        "model_id", "element_id", F.concat("element_id", F.lit("_"), "storey.name").alias("id"), F.lit(LIFT_NAME).alias("name"), F.lit(LIFT).alias("type"),
        F.col("storey.name").alias("level"), "x", "y", F.col("storey.elevation").alias("z"), F.lit(True).alias("accessible"), (F.col("ord") + 4 * F.col("pos")).alias("ord"), "pos",
    )


def lift_edges(nodes: DataFrame, doors: DataFrame, areas: DataFrame) -> DataFrame:
    """Edges between a lift's neighbouring storeys, to up to two doors in reach on each, or else to the nearest area."""
    order = Window.partitionBy("model_id", "element_id").orderBy("pos")
    steps = nodes.select("model_id", F.lag("id").over(order).alias("below"), F.lag("z").over(order).alias("below_z"), "id", "x", "y", "z", "ord").where("below IS NOT NULL")
    coords = straight(point(F.col("x"), F.col("y"), F.col("below_z")), point(F.col("x"), F.col("y"), F.col("z")))
    between = steps.select(*_edge(F.col("below"), F.col("id"), LIFT_EDGE, 1.0, True, coords, F.col("ord")))
    spots = nodes.select(*SPOT).distinct()
    found = written(doors_at(spots, doors, DOOR_REACH, DOORS_PER_LEVEL))
    rest = nodes.join(found.select(*SPOT).distinct(), SPOT, "left_anti")
    boxes = areas.select("model_id", "level", F.col("id").alias("area_id"), F.col("x").alias("area_x"), F.col("y").alias("area_y"), F.col("ord").alias("area_ord"), "min_x", "min_y", "max_x", "max_y")
    beside = near_boxes(rest.select(*SPOT).distinct(), boxes, ["model_id", "level"], AREA_REACH).withColumn("d", box_distance_2d(F.col("x"), F.col("y"), "")).where(F.col("d") <= AREA_REACH)
    beside = first_of(beside.select(*SPOT, "d", "area_id", "area_x", "area_y", "area_ord"), SPOT, [F.col("d"), F.col("area_ord")])
    linked, held = nodes.join(found, SPOT), rest.join(beside, SPOT)
    return between.unionByName(to_door_edges(linked, F.col("ord") + F.col("rank"))).unionByName(to_area_edges(held, F.col("ord") + 1))
