"""Floor outlines: low edges of walls, by level."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayhall.functions.geometry import distance_2d, half_even, point
from wayhall.functions.text import or_default, stripped
from wayhall.operators.base import KEY, of_elements
from wayhall.plans.checkpoint import cut, dealt
from wayhall.plans.spatial import nearest_storey
from wayhall.schema import SCANNED_WALLS, UNKNOWN_STOREY, WALLS

LOW, SHORTEST, DIGITS = 0.25, 0.20, 3


def low_edges(vertices: DataFrame, low: float = LOW) -> DataFrame:
    """model_id, element_id, seg, coords: edges between consecutive low vertices, and back to the first if there are over two.

    Vertices that agree in x and y to three digits count once, at the first. Only edges longer than 0.20 stay. The vertices
    are dealt once, by element; the steps that follow stay where they are.
    """
    return _edges(dealt(vertices, *KEY), low)


def _edges(vertices: DataFrame, low: float = LOW) -> DataFrame:
    """low_edges() of vertices that are dealt by element."""
    base = F.min("z").over(Window.partitionBy(*KEY))
    spots = vertices.withColumn("__base", base).where(F.col("z") <= F.col("__base") + low)
    spots = spots.groupBy(*KEY, half_even(F.col("x"), DIGITS).alias("kx"), half_even(F.col("y"), DIGITS).alias("ky")).agg(F.min(F.struct("vseq", "x", "y")).alias("p"))
    own = Window.partitionBy(*KEY)
    order = own.orderBy("p.vseq")
    rows = spots.select(
        *KEY, "p", F.row_number().over(order).alias("seg"), F.lead("p").over(order).alias("next"),
        F.first("p").over(order).alias("first"), F.count(F.lit(1)).over(own).alias("n"),
    )
    rows = rows.withColumn("next", F.coalesce("next", F.when(F.col("n") > 2, F.col("first")))).where("next IS NOT NULL")
    rows = rows.where(distance_2d(F.col("p.x"), F.col("p.y"), F.col("next.x"), F.col("next.y")) > SHORTEST)
    return rows.select(*KEY, "seg", F.array(point(F.col("p.x"), F.col("p.y")), point(F.col("next.x"), F.col("next.y"))).alias("coords"))


def wall_levels(walls: DataFrame, geo: DataFrame, levels: DataFrame) -> DataFrame:
    """walls with level: the storey that contains it by name, else the one nearest to its base, else unknown."""
    held = F.when(F.col("container_class") == "IfcBuildingStorey", stripped(or_default(F.col("container_name"), UNKNOWN_STOREY)))
    found = walls.join(geo.select(*KEY, "min_z"), KEY, "left").join(levels, "model_id", "left")
    snapped = F.when(F.col("min_z").isNotNull(), nearest_storey(F.col("min_z"))["name"])
    return found.withColumn("level", F.coalesce(held, snapped, F.lit(UNKNOWN_STOREY))).drop("storeys", "min_z")


def _roles(walls: DataFrame, rel_boundary: DataFrame) -> DataFrame:
    """model_id, element_id, level, o: the first role (phase, at) of each wall on a level, phases as in outlines()."""
    second = F.when(F.col("ifc_class") == "IfcWall", 0).otherwise(1).cast("long") * (1 << 38)
    scanned = F.col("ifc_class").isin(*SCANNED_WALLS)
    role = lambda phase, at: F.struct(F.lit(phase).alias("phase"), at.alias("at"))
    bound = rel_boundary.groupBy("model_id", "element_id").agg(F.min(role(1, F.col("seq"))).alias("bound"))
    at = second + F.col("seq")
    first = F.coalesce("bound", F.when(scanned & F.coalesce("is_external", F.lit(False)), role(2, at)), F.when(scanned, role(3, at)))
    return walls.join(bound, KEY, "left").withColumn("o", first).where("o IS NOT NULL").groupBy(*KEY, "level").agg(F.min("o").alias("o"))


def outlines(elements: DataFrame, vertices: DataFrame, rel_boundary: DataFrame, geo: DataFrame, levels: DataFrame) -> DataFrame:
    """model_id, level, element_id, seq, coords: walls that bound a space, then external walls; if a model gets no edge so, all walls.

    A wall counts once on a level, in the first of these roles. Roles, and the edges of the first two, are computed once, in
    the folder of spark.checkpoint.dir; other walls are drawn where a model needs them only.
    """
    walls = wall_levels(elements.where(F.col("ifc_class").isin(*WALLS)).select(*KEY, "seq", "ifc_class", "is_external", "container_class", "container_name"), geo, levels)
    once = cut(_roles(walls, rel_boundary))
    drawn = lambda which: which.join(_edges(of_elements(dealt(vertices, *KEY), which)), KEY)
    found = cut(drawn(once.where("o.phase < 3")))
    rest = once.where("o.phase = 3").join(found.select("model_id").distinct(), "model_id", "left_anti")
    if not rest.isEmpty():
        found = found.unionByName(drawn(rest))
    return found.select("model_id", "level", "element_id", (F.col("o.phase") * F.lit(1 << 54) + F.col("o.at") * 4096 + F.col("seg")).alias("seq"), "coords")
