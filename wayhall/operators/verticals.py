"""Stairs, landings and ramps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayhall.functions.geometry import at_height, distance_2d, in_box_3d, path_by_corner, path_from_door, point, straight
from wayhall.operators.base import KEY, first_scan, of_elements, ordinal
from wayhall.plans.checkpoint import written
from wayhall.plans.spatial import first_k, first_of, near_boxes, near_points, nearest_storey
from wayhall.schema import BARRIER, FLIGHT, LANDING, RAMP, RAMP_EDGE, RAMP_NAMES, STAIR, STAIR_NAMES, VERTICAL_AREA, VERTICAL_DOOR
from wayhall.sources.tables import scan

STAIR_REACH, RAMP_REACH, DOOR_REACH = 0.35, 0.40, 3.0
BAND_SHARE, BAND_LEAST, LEAST_RISE = 0.10, 0.15, 0.15
LANDING_NEAR, LANDING_STEP, LANDING_FACTOR, LANDING_LEAST = 1.5, 0.5, 1.2, 0.5
ENDS = ("START", "END")
#: A place, one that is looked up at the height of its storey, and where flights end and start.
SPOT, PROBE = ["model_id", "level", "x", "y"], ["model_id", "level", "x", "y", "probe_z"]
HEAD, FOOT = ["model_id", "ex", "ey", "ez"], ["model_id", "sx", "sy", "sz"]


def flight_ends(elements: DataFrame, vertices: DataFrame, levels: DataFrame) -> DataFrame:
    """One row for each stair flight with vertices: sx, sy, sz, ex, ey, ez, level_s, level_e, elev_s, elev_e, seq.

    Ends lie at the mean of the vertices in the lowest and the highest tenth of the rise, at least 0.15.
    """
    flights = first_scan(scan(elements, "IfcStairFlight")).select(*KEY, "seq")
    mine = of_elements(vertices, flights)
    rise = mine.groupBy(*KEY).agg(F.min("z").alias("sz"), F.max("z").alias("ez"))
    banded = mine.join(rise.withColumn("tol", F.greatest((F.col("ez") - F.col("sz")) * BAND_SHARE, F.lit(BAND_LEAST))), KEY)
    low, high = F.col("z") <= F.col("sz") + F.col("tol"), F.col("z") >= F.col("ez") - F.col("tol")
    ends = banded.groupBy(*KEY, "sz", "ez").agg(
        F.avg(F.when(low, F.col("x"))).alias("sx"), F.avg(F.when(low, F.col("y"))).alias("sy"),
        F.avg(F.when(high, F.col("x"))).alias("ex"), F.avg(F.when(high, F.col("y"))).alias("ey"),
    )
    return _levelled(ends.join(flights, KEY), levels)


def ramp_ends(elements: DataFrame, vertices: DataFrame, levels: DataFrame) -> DataFrame:
    """As flight_ends(), for ramps that rise by 0.15 or more; ends are the first lowest and the first highest vertex."""
    ramps = scan(elements, "IfcRamp", "IfcRampFlight").withColumn("seq", F.col("seq") + F.when(F.col("ifc_class") == "IfcRampFlight", F.lit(1 << 38)).otherwise(F.lit(0)))
    ramps = first_scan(ramps).select(*KEY, "seq")
    spot = F.struct("x", "y", "z")
    ends = of_elements(vertices, ramps).groupBy(*KEY).agg(
        F.min_by(spot, F.struct("z", "vseq")).alias("s"), F.max_by(spot, F.struct(F.col("z"), -F.col("vseq"))).alias("e")
    )
    ends = ends.select(*KEY, *(F.col(f"{p}.{c}").alias(f"{p}{c}") for p in "se" for c in "xyz"))
    return _levelled(ends.where(~(F.col("ez") - F.col("sz") < LEAST_RISE)).join(ramps, KEY), levels)


def _levelled(ends: DataFrame, levels: DataFrame) -> DataFrame:
    snapped = ends.join(levels, "model_id").withColumns({"__s": nearest_storey(F.col("sz")), "__e": nearest_storey(F.col("ez"))})
    return snapped.withColumns({f"{n}_{p}": F.col(f"__{p}.{f}") for p in "se" for n, f in (("level", "name"), ("elev", "elevation"))}).drop("__s", "__e", "storeys")


def _node_id(end: int) -> Column:
    return F.concat("element_id", F.lit(f"_{ENDS[end]}"))


def end_nodes(ends: DataFrame, kind: str) -> DataFrame:
    """Two nodes for each row: stairs at their real height, ramps at that of the storey."""
    names, accessible = (STAIR_NAMES, False) if kind == STAIR else (RAMP_NAMES, True)
    # Both from one row: of a union of two, whoever looks for what is missing would do so twice.
    parts = [
        F.struct(
            _node_id(i).alias("id"), F.lit(names[i]).alias("name"), F.lit(kind).alias("type"), F.col(f"level_{p}").alias("level"),
            F.col(f"{p}x").alias("x"), F.col(f"{p}y").alias("y"), F.col(f"{p}z" if kind == STAIR else f"elev_{p}").alias("z"),
            F.lit(accessible).alias("accessible"), F.col(f"elev_{p}").alias("probe_z"), ordinal(kind, F.col("seq"), i).alias("ord"),
        )
        for i, p in enumerate("se")
    ]
    return ends.select("model_id", "element_id", "seq", F.explode(F.array(*parts)).alias("__n")).select("model_id", "element_id", "seq", "__n.*")


def _edge(a: Column, b: Column, kind: str, weight: Column | float, accessible: bool, coords: Column, order: Column) -> list[Column]:
    weight = F.lit(weight) if isinstance(weight, float) else weight
    return [F.col("model_id"), a.alias("a"), b.alias("b"), F.lit(kind).alias("edge_type"), weight.alias("weight"), F.lit(accessible).alias("accessible"), coords.alias("coords"), order.alias("ord")]


def inner_edges(ends: DataFrame, kind: str) -> DataFrame:
    """The edge from start to end of each flight or ramp."""
    z = ("sz", "ez") if kind == STAIR else ("elev_s", "elev_e")
    coords = straight(point(F.col("sx"), F.col("sy"), F.col(z[0])), point(F.col("ex"), F.col("ey"), F.col(z[1])))
    weight, edge, accessible = (BARRIER, FLIGHT, False) if kind == STAIR else (1.2, RAMP_EDGE, True)
    return ends.select(*_edge(_node_id(0), _node_id(1), edge, weight, accessible, coords, ordinal(kind, F.col("seq"), 2)))


def _area_at(spots: DataFrame, areas: DataFrame, reach: float) -> DataFrame:
    """Of spots (PROBE), those held by an area of their level: area_id, area_x, area_y, area_ord of the first in scan order."""
    boxes = areas.select(
        "model_id", "level", F.col("id").alias("area_id"), F.col("x").alias("area_x"), F.col("y").alias("area_y"), F.col("ord").alias("area_ord"),
        *(f"{m}_{c}" for m in ("min", "max") for c in "xyz"),
    )
    held = near_boxes(spots, boxes, ["model_id", "level"], reach).where(in_box_3d(F.col("x"), F.col("y"), F.col("probe_z"), "", reach))
    return first_of(held.select(*PROBE, "area_id", "area_x", "area_y", "area_ord"), PROBE, [F.col("area_ord")])


def area_of_end(nodes: DataFrame, areas: DataFrame, reach: float) -> DataFrame:
    """Nodes with the first area, in scan order, of their level that holds (x, y, storey elevation): area_id, area_x, area_y.

    Ends of one place have the same area, which is looked for once.
    """
    return nodes.join(_area_at(nodes.select(*PROBE).distinct(), areas, reach), PROBE)


def doors_at(spots: DataFrame, doors: DataFrame, reach: float, k: int) -> DataFrame:
    """spots (SPOT) with the k nearest doors of their level, at most reach away: r_id, r_x, r_y, r_normal, r_ord, d, rank.

    Of doors of one place only the first k can be among them.
    """
    first = first_k(doors.select(*SPOT, "id", "normal", "ord"), SPOT, [F.col("ord")], k).drop("rank")
    near = near_points(spots, first, ["model_id", "level"], reach)
    near = near.withColumn("d", distance_2d(F.col("x"), F.col("y"), F.col("r_x"), F.col("r_y"))).where(F.col("d") <= reach)
    return first_k(near, SPOT, [F.col("d"), F.col("r_ord")], k)


def door_of_end(nodes: DataFrame, doors: DataFrame, reach: float = DOOR_REACH) -> DataFrame:
    """Nodes with the nearest door of their level, at most reach away: r_id, r_x, r_y, r_normal, d."""
    return nodes.join(doors_at(nodes.select(*SPOT).distinct(), doors, reach, 1).drop("rank"), SPOT)


def to_area_edges(found: DataFrame, order: Column) -> DataFrame:
    """Edges from vertical nodes to their area_id, open to all."""
    path = path_by_corner(point(F.col("x"), F.col("y")), point(F.col("area_x"), F.col("area_y")))
    return found.select(*_edge(F.col("id"), F.col("area_id"), VERTICAL_AREA, 1.0, True, at_height(path, F.col("z")), order))


def to_door_edges(found: DataFrame, order: Column) -> DataFrame:
    """Edges from vertical nodes to door r_id, open to all whatever the door's width."""
    path = F.reverse(path_from_door(point(F.col("r_x"), F.col("r_y")), point(F.col("x"), F.col("y")), F.col("r_normal")))
    return found.select(*_edge(F.col("id"), F.col("r_id"), VERTICAL_DOOR, 1.0, True, at_height(path, F.col("z")), order))


def end_links(nodes: DataFrame, areas: DataFrame, doors: DataFrame, reach: float) -> DataFrame:
    """Each end's edge: to the area that holds it, else to the nearest door in reach."""
    held = written(_area_at(nodes.select(*PROBE).distinct(), areas, reach))
    rest = nodes.join(held.select(*PROBE), PROBE, "left_anti")
    order = F.col("ord") + 8
    return to_area_edges(nodes.join(held, PROBE), order).unionByName(to_door_edges(door_of_end(rest, doors), order))


def _landing(pairs: DataFrame, order: Column, *more: str) -> DataFrame:
    """Edges from the end of one flight (e..) to the start of another (s..)."""
    gap = distance_2d(F.col("ex"), F.col("ey"), F.col("sx"), F.col("sy"))
    coords = straight(point(F.col("ex"), F.col("ey"), F.col("ez")), point(F.col("sx"), F.col("sy"), F.col("sz")))
    weight = F.greatest(gap * LANDING_FACTOR, F.lit(LANDING_LEAST))
    return pairs.select(*_edge(F.concat("from_id", F.lit("_END")), F.concat("to_id", F.lit("_START")), LANDING, weight, False, coords, order), *more)


def consecutive_flights(ends: DataFrame, rel_aggregates: DataFrame, elements: DataFrame) -> DataFrame:
    """from_id, to_id and their ends: neighbouring flights of one stair in the order of their base."""
    stairs = scan(elements, "IfcStair").select("model_id", F.col("element_id").alias("parent_id")).distinct()
    parts = rel_aggregates.join(stairs, ["model_id", "parent_id"], "left_semi").withColumnRenamed("child_id", "element_id")
    flights = parts.select("model_id", "parent_id", "element_id", F.col("seq").alias("rel"), "child_pos").join(ends.select(*KEY, *(f"{p}{k}" for p in "se" for k in "xyz")), KEY)
    order = Window.partitionBy("model_id", "parent_id").orderBy("sz", "rel", "child_pos")
    nxt = lambda c: F.lead(c).over(order)
    rows = flights.select("model_id", "parent_id", F.col("element_id").alias("from_id"), nxt("element_id").alias("to_id"), "ex", "ey", "ez", *(nxt(c).alias(c) for c in ("sx", "sy", "sz")), "rel", "child_pos")
    rows = rows.where("to_id IS NOT NULL AND from_id <> to_id")
    return first_of(rows, ["model_id", "from_id", "to_id"], [F.col("rel"), F.col("child_pos")])


def _close() -> Column:
    """Whether (ex, ey, ez) is within 1.5 and 0.5 in height of (sx, sy, sz)."""
    return (distance_2d(F.col("ex"), F.col("ey"), F.col("sx"), F.col("sy")) <= LANDING_NEAR) & (F.abs(F.col("ez") - F.col("sz")) <= LANDING_STEP)


def near_places(ends: DataFrame) -> DataFrame:
    """HEAD and FOOT: distinct places where flights end, and those near them where flights start."""
    # With their height in the key.
    place = lambda names: ends.select("model_id", *(F.col(n).alias(c) for n, c in zip(names[1:], "xyz", strict=True))).distinct()
    band = F.floor(F.col("z") / (2 * LANDING_STEP))
    heads = place(HEAD).withColumn("band", F.explode(F.array(F.floor((F.col("z") - LANDING_STEP) / (2 * LANDING_STEP)), F.floor((F.col("z") + LANDING_STEP) / (2 * LANDING_STEP)))))
    near = near_points(heads.distinct(), place(FOOT).withColumn("band", band), ["model_id", "band"], LANDING_NEAR)
    return near.select("model_id", *(F.col(c).alias(f"e{c}") for c in "xyz"), *(F.col(f"r_{c}").alias(f"s{c}") for c in "xyz")).where(_close())


def near_flights(ends: DataFrame, near: DataFrame | None = None, head: tuple[str, ...] = (), foot: tuple[str, ...] = ()) -> DataFrame:
    """from_id, to_id and their ends: flights whose end is within 1.5 and 0.5 in height of another one's start.

    near is near_places() where it is known; head and foot are more columns of ends, of the one and the other.
    """
    left = ends.select(*HEAD, F.col("element_id").alias("from_id"), F.col("seq").alias("from_seq"), *head)
    right = ends.select(*FOOT, F.col("element_id").alias("to_id"), F.col("seq").alias("to_seq"), *foot)
    # Few places may stand for very many pairs of flights, so they are spread by number, not by size.
    near = near_places(ends) if near is None else near
    near = near.repartition(int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions")), *HEAD, *FOOT[1:])
    return near.join(left, HEAD).join(right, FOOT).where(F.col("from_id") != F.col("to_id")).select(
        "model_id", "from_id", "to_id", "ex", "ey", "ez", "sx", "sy", "sz", "from_seq", "to_seq", *head, *foot,
    )


def stair_landings(by_stair: DataFrame) -> DataFrame:
    """Edges of consecutive_flights()."""
    return _landing(by_stair, ordinal("landing", F.col("rel"), F.least(F.col("child_pos"), F.lit(4095))))


def near_landings(ends: DataFrame, by_stair: DataFrame, near: DataFrame | None = None, head: tuple[str, ...] = (), foot: tuple[str, ...] = ()) -> DataFrame:
    """Edges of near_flights() where there is none by stair, with the columns head and foot. No pair is shuffled to find out: a flight tells what follows it."""
    follow = by_stair.groupBy("model_id", F.col("from_id").alias("element_id")).agg(F.collect_set("to_id").alias("follow"))
    pairs = near_flights(ends.join(follow, KEY, "left"), near, ("follow", *head), foot).where(~F.coalesce(F.array_contains("follow", F.col("to_id")), F.lit(False)))
    return _landing(pairs, ordinal("landing_near", F.col("from_seq"), F.pmod("to_seq", F.lit(4096))), *head, *foot)


def landing_edges(ends: DataFrame, rel_aggregates: DataFrame, elements: DataFrame) -> DataFrame:
    """Landings by stair, then landings by nearness where there is none yet."""
    by_stair = consecutive_flights(ends, rel_aggregates, elements)
    return stair_landings(by_stair).unionByName(near_landings(ends, by_stair))


def count_near_landings(ends: DataFrame, by_stair: DataFrame, near: DataFrame) -> DataFrame:
    """model_id, n: how many near_landings() has in each model, from the flights of places, without pairs."""
    at = lambda key, name: ends.groupBy(*key).agg(F.count(F.lit(1)).alias(name))
    pairs = near.join(at(HEAD, "heads"), HEAD).join(at(FOOT, "feet"), FOOT).select("model_id", (F.col("heads") * F.col("feet")).alias("n"))
    less = ends.where(_close()).select("model_id").unionByName(by_stair.where(_close()).select("model_id"))
    return pairs.unionByName(less.select("model_id", F.lit(-1).cast("long").alias("n"))).groupBy("model_id").agg(F.sum("n").alias("n"))
