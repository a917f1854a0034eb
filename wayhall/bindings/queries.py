"""One query for each operator over the derived building, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayhall.api import build_nodes, build_summary, build_ways, route_responses
from wayhall.bindings import details, models
from wayhall.bindings.views import M, TRANSPORT_HEIGHT, VIEWS, building, vertices, view, with_views
from wayhall.functions.text import is_lift_by_text
from wayhall.operators import areas, base, doors, graph, lifts, outline, verticals
from wayhall.plans import overlay, paths
from wayhall.plans.spatial import nearest_storey, storey_list, touched_storeys
from wayhall.sinks import export, payload
from wayhall.sources.tables import scan

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
c = F.col


def query(sql: str | None = None, *views: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = with_views(sql, *views) if views else sql
        return f

    return add


def r6(x: Column, name: str) -> Column:
    return (F.round(x, 6) + F.lit(0.0)).alias(name)


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return storey_list(view(spark, sf_dir, "bld_storeys"))


def named(df: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """lv as the level's name."""
    at = view(spark, sf_dir, "bld_storeys").select(c("seq").alias("lv"), c("name").alias("level"))
    return df.join(at, "lv").drop("lv")


def door_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = named(view(spark, sf_dir, "bld_doors"), spark, sf_dir)
    axis = F.struct(F.lit(0.6).alias("x"), F.lit(0.8).alias("y"))
    return rows.withColumns({"accessible": doors.wide_enough(c("width")), "normal": axis, "ord": c("seq") * 8})


def area_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = named(view(spark, sf_dir, "bld_spaces"), spark, sf_dir)
    return rows.withColumns({"x": (c("min_x") + c("max_x")) / 2, "y": (c("min_y") + c("max_y")) / 2, "ord": c("seq")})


def flight_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "bld_flights").withColumns({"element_id": c("flight_id").cast("string"), "seq": c("flight_id")})


def end_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flight starts spread over the floor, as vertical nodes with their level."""
    rows = view(spark, sf_dir, "bld_flights").select(
        "model_id", F.concat(F.lit("F"), c("flight_id").cast("string")).alias("id"), (c("sx") * 32).alias("x"), (c("sy") * 32).alias("y"), c("sz").alias("z"),
        c("sz").alias("probe_z"), (c("sz") / 4).cast("int").alias("lv"), c("flight_id").alias("ord"),
    )
    return named(rows, spark, sf_dir)


END_SQL = "e AS (SELECT CONCAT('F', CAST(flight_id AS VARCHAR(20))) AS id, sx * 32 AS x, sy * 32 AS y, sz AS z, CAST(sz / 4 AS INTEGER) AS lv, flight_id FROM bld_flights)"
DIST = "sqrt(({0} - {2}) * ({0} - {2}) + ({1} - {3}) * ({1} - {3}))"


def dist(a: str, b: str, x: str, y: str) -> str:
    return DIST.format(a, b, x, y)


@query("SELECT CASE WHEN l_orderkey % 8 < 3 THEN 'IfcWall' ELSE 'IfcWallStandardCase' END AS ifc_class, count(DISTINCT l_orderkey) AS n FROM lineitem WHERE l_orderkey % 8 < 6 GROUP BY 1")
def s3_typed_scan(spark, sf_dir):
    return scan(building(spark, sf_dir).elements, "IfcWall").groupBy("ifc_class").agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT CONCAT('V', CAST(element_id AS VARCHAR(20))) AS element_id, count(*) AS n_vertices, round(avg(x), 6) + 0.0 AS cx, round(avg(y), 6) + 0.0 AS cy, round(avg(z), 6) + 0.0 AS cz,
    min(x) AS min_x, min(y) AS min_y, min(z) AS min_z, max(x) AS max_x, max(y) AS max_y, max(z) AS max_z FROM bld_vertices GROUP BY element_id""",
    "bld_vertices",
)
def a1_geometry(spark, sf_dir):
    geo = base.geometry(vertices(spark, sf_dir)).drop("model_id")
    return geo.withColumns({k: F.round(k, 6) + F.lit(0.0) for k in ("cx", "cy", "cz")})


AXIS_SQL = """, m AS (SELECT *, min(z) OVER (PARTITION BY element_id) AS base FROM bld_vertices),
l AS (SELECT *, sum(CASE WHEN z <= base + 0.4 THEN 1 ELSE 0 END) OVER (PARTITION BY element_id) AS k FROM m),
s AS (SELECT element_id, count(*) AS n, count(*) * (avg(x * x) - avg(x) * avg(x)) AS sxx, count(*) * (avg(y * y) - avg(y) * avg(y)) AS syy, count(*) * (avg(x * y) - avg(x) * avg(y)) AS sxy
  FROM l WHERE k < 2 OR z <= base + 0.4 GROUP BY element_id),
v AS (SELECT element_id, n, sxy AS x, (sxx + syy) / 2 + sqrt(greatest((sxx + syy) * (sxx + syy) / 4 - (sxx * syy - sxy * sxy), 0)) - sxx AS y, sxx, syy FROM s)"""


@query(
    AXIS_SQL[2:] + """ SELECT CONCAT('V', CAST(element_id AS VARCHAR(20))) AS element_id,
    round(CASE WHEN n < 2 THEN 1 WHEN abs(x) < 1e-7 AND abs(y) < 1e-7 THEN CASE WHEN sxx >= syy THEN 1 ELSE 0 END ELSE x / sqrt(x * x + y * y) END, 4) + 0.0 AS ax FROM v""",
)
def a2_main_axis(spark, sf_dir):
    axes = doors.mesh_axes(vertices(spark, sf_dir))
    return axes.select("element_id", (F.round("axis.x", 4) + F.lit(0.0)).alias("ax"))


ORACLES["a2_main_axis"] = with_views("SELECT 1", "bld_vertices").replace(" SELECT 1", ", " + ORACLES["a2_main_axis"])

#: Axes (ax, ay) of all meshes, after AXIS_SQL.
WHOLE_AXIS = """SELECT element_id, CASE WHEN n < 2 THEN 1 WHEN abs(x) < 1e-7 AND abs(y) < 1e-7 THEN CASE WHEN sxx >= syy THEN 1 ELSE 0 END ELSE x / sqrt(x * x + y * y) END AS ax,
  CASE WHEN n < 2 THEN 0 WHEN abs(x) < 1e-7 AND abs(y) < 1e-7 THEN CASE WHEN sxx >= syy THEN 0 ELSE 1 END ELSE y / sqrt(x * x + y * y) END AS ay FROM v"""
#: Doors with their frame: that of the wall they stand in, else their own, which is x for two vertices at one place. After AXIS_SQL.
FRAMES_SQL = f"""axes AS MATERIALIZED ({WHOLE_AXIS}),
door AS MATERIALIZED (SELECT d.id, d.seq, d.lv, d.x, d.y, l.elevation AS z, l.name AS level, d.width, CASE WHEN width > 0 THEN width >= 0.85 ELSE TRUE END AS open, coalesce(a.ax, 1) AS ax, coalesce(a.ay, 0) AS ay, -coalesce(a.ay, 0) AS nx, coalesce(a.ax, 1) AS ny
  FROM bld_doors d JOIN bld_storeys l ON d.lv = l.seq LEFT JOIN axes a ON d.seq % 2 = 0 AND a.element_id = d.seq % 1000 + 1 AND a.element_id % 8 < 6)"""


@query()
def g8_door_frames(spark, sf_dir):
    """Axis and normal of all doors, most of them from the wall that they stand in."""
    b = building(spark, sf_dir)
    found = doors.doors(b.elements, base.geometry(b.vertices), levels(spark, sf_dir), b.vertices, b.rel_fills, b.rel_voids)
    return found.select("id", "level", "x", "y", "z", "width", "accessible", *((F.round(f"{k}.{i}", 4) + F.lit(0.0)).alias(f"{k}_{i}") for k in ("axis", "normal") for i in "xy"))


ORACLES["g8_door_frames"] = with_views("", "bld_vertices", "bld_doors", "bld_storeys").rstrip() + AXIS_SQL + ", " + FRAMES_SQL + """
SELECT id, level, x, y, z, width, open AS accessible, round(ax, 4) + 0.0 AS axis_x, round(ay, 4) + 0.0 AS axis_y, round(nx, 4) + 0.0 AS normal_x, round(ny, 4) + 0.0 AS normal_y FROM door"""


RAMP_SQL = """SELECT CONCAT('V', CAST(element_id AS VARCHAR(20))) AS element_id, arg_min(x, (z, vseq)) AS sx, arg_min(y, (z, vseq)) AS sy, min(z) AS sz,
    arg_max(x, (z, -vseq)) AS ex, arg_max(y, (z, -vseq)) AS ey, max(z) AS ez FROM bld_vertices WHERE element_id % 8 >= 6 GROUP BY element_id HAVING max(z) - min(z) >= 0.15"""


@query(
    RAMP_SQL,
    "bld_vertices",
)
def a4_ramp_ends(spark, sf_dir):
    b = building(spark, sf_dir)
    return verticals.ramp_ends(b.elements, b.vertices, levels(spark, sf_dir)).select("element_id", "sx", "sy", "sz", "ex", "ey", "ez")


@query(
    """SELECT CONCAT('F', CAST(flight_id AS VARCHAR(20))) AS element_id, sx, sy, sz, ex, ey, ez,
    (SELECT arg_min(name, (abs(elevation - sz), elevation, seq)) FROM bld_storeys) AS level_s, (SELECT arg_min(name, (abs(elevation - ez), elevation, seq)) FROM bld_storeys) AS level_e FROM bld_flights""",
    "bld_flights", "bld_storeys",
)
def a3_flight_ends(spark, sf_dir):
    b = building(spark, sf_dir)
    return verticals.flight_ends(b.elements, b.vertices, levels(spark, sf_dir)).select("element_id", "sx", "sy", "sz", "ex", "ey", "ez", "level_s", "level_e")


@query(
    "SELECT id, z, (SELECT arg_min(name, (abs(elevation - z * 1.25), elevation, seq)) FROM bld_storeys) AS level FROM bld_doors", "bld_doors", "bld_storeys",
)
def j1_storey_snap(spark, sf_dir):
    rows = view(spark, sf_dir, "bld_doors").join(levels(spark, sf_dir), "model_id")
    return rows.select("id", "z", nearest_storey(c("z") * 1.25)["name"].alias("level"))


@query("SELECT trim(r_name) AS name, CASE WHEN r_regionkey % 2 = 0 THEN r_regionkey * 4e0 ELSE 0e0 END AS elevation, CAST(r_regionkey AS BIGINT) AS seq FROM region")
def p1_storeys(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/region.parquet")
    dirty = rows.select(
        F.lit(M).alias("model_id"), c("r_regionkey").cast("long").alias("seq"), F.lit("IfcBuildingStorey").alias("ifc_class"), F.concat(F.lit("\t "), "r_name", F.lit("\n")).alias("name"),
        F.when(c("r_regionkey") % 2 == 0, (c("r_regionkey") * 4).cast("string")).otherwise("?").alias("elevation"),
    )
    return base.storeys(dirty).drop("model_id")


@query("SELECT id, width, CASE WHEN width > 0 THEN width >= 0.85 ELSE TRUE END AS accessible FROM bld_doors", "bld_doors")
def f9_door_accessible(spark, sf_dir):
    return door_rows(spark, sf_dir).select("id", "width", "accessible")


@query("SELECT id, seq FROM bld_spaces WHERE seq % 3 = 0 AND seq % 12 <> 0 AND NOT (4 * (max_x - min_x) > 10 AND 4 * (max_y - min_y) > 10)", "bld_spaces")
def f3_candidate_slabs(spark, sf_dir):
    rows = view(spark, sf_dir, "bld_spaces").where("seq % 3 = 0").withColumns({"predefined_type": F.when(c("seq") % 12 == 0, "roof"), "max_x": c("min_x") + 4 * (c("max_x") - c("min_x")), "max_y": c("min_y") + 4 * (c("max_y") - c("min_y"))})
    return areas.candidate_slabs(rows).select("id", "seq")


@query(
    """SELECT CONCAT('D', CAST(c_custkey AS VARCHAR(20))) AS element_id, CONCAT('V', CAST(c_custkey % 1000 + 1 AS VARCHAR(20))) AS wall_id FROM customer
    WHERE c_custkey % 2 = 0 AND (c_custkey % 1000 + 1) % 8 < 6 AND c_custkey % 1000 + 1 IN (SELECT l_orderkey FROM lineitem)""",
)
def j2_host_walls(spark, sf_dir):
    b = building(spark, sf_dir)
    return doors.host_walls(b.rel_fills, b.rel_voids, b.elements).drop("model_id")


NEAR_SQL = """, p AS (SELECT d.id AS door, s.id AS area, s.seq, d.x, d.y, (s.min_x + s.max_x) / 2 AS tx, (s.min_y + s.max_y) / 2 AS ty, d.width,
  CASE WHEN d.x BETWEEN s.min_x - 0.65 AND s.max_x + 0.65 AND d.y BETWEEN s.min_y - 0.65 AND s.max_y + 0.65 THEN 0.0
    ELSE sqrt(pow(greatest(s.min_x - d.x, 0, d.x - s.max_x), 2) + pow(greatest(s.min_y - d.y, 0, d.y - s.max_y), 2)) END AS d
  FROM bld_doors d JOIN bld_spaces s ON d.lv = s.lv),
r AS (SELECT *, row_number() OVER (PARTITION BY door ORDER BY d, seq) AS rank FROM p WHERE d <= 1.10)"""


@query()
def j3_door_areas(spark, sf_dir):
    found = doors.door_areas(door_rows(spark, sf_dir), area_rows(spark, sf_dir))
    return found.select(c("id").alias("door"), c("area_id").alias("area"), r6(c("d"), "d"), "rank")


ORACLES["j3_door_areas"] = with_views("", "bld_doors", "bld_spaces").rstrip() + NEAR_SQL + " SELECT door, area, round(d, 6) + 0.0 AS d, rank FROM r WHERE rank <= 2"


@query()
def b2_door_edges(spark, sf_dir):
    edges = doors.door_edges(doors.door_areas(door_rows(spark, sf_dir), area_rows(spark, sf_dir)))
    mid = F.element_at("coords", 2)
    return edges.select(c("a").alias("door"), c("b").alias("area"), "weight", "accessible", F.size("coords").alias("n_points"), r6(mid["x"], "x2"), r6(mid["y"], "y2"))


ORACLES["b2_door_edges"] = (
    with_views("", "bld_doors", "bld_spaces").rstrip() + NEAR_SQL
    + """, t AS (SELECT *, (tx - x) * 0.6 + (ty - y) * 0.8 AS k FROM r WHERE rank <= 2), q AS (SELECT *, x + k * 0.6 AS px, y + k * 0.8 AS py FROM t),
f AS (SELECT *, sqrt((px - x) * (px - x) + (py - y) * (py - y)) > 1e-6 AS far1, sqrt((px - tx) * (px - tx) + (py - ty) * (py - ty)) > 1e-6 AS far2 FROM q)
SELECT door, area, CASE WHEN width > 0 AND width < 0.85 THEN 999999e0 ELSE 1e0 END AS weight, NOT (width > 0 AND width < 0.85) AS accessible,
  CASE WHEN far1 AND far2 THEN 3 ELSE 2 END AS n_points, round(CASE WHEN far1 THEN px ELSE tx END, 6) + 0.0 AS x2, round(CASE WHEN far1 THEN py ELSE ty END, 6) + 0.0 AS y2 FROM f"""
)


def greedy_sql(pairs: str, result: str) -> str:
    """result over gone (item) and pairs (earlier, later): the refused of a pass in order, an item for each step, in recursive SQL."""
    return f"""SELECT * FROM (WITH RECURSIVE pairs AS ({pairs}),
  q AS (SELECT later, list(earlier) AS before, row_number() OVER (ORDER BY later) AS n FROM pairs GROUP BY later),
  g AS (SELECT CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS items UNION ALL
    SELECT q.n, CASE WHEN len(list_filter(q.before, lambda x: NOT list_contains(g.items, x))) > 0 THEN list_append(g.items, q.later) ELSE g.items END FROM g JOIN q ON q.n = g.n + 1),
  gone AS (SELECT unnest(items) AS item FROM (SELECT items FROM g ORDER BY n DESC LIMIT 1)) {result})"""


HOLDS = "b.min_x - 0.1 <= a.cx AND a.cx <= b.max_x + 0.1 AND b.min_y - 0.1 <= a.cy AND a.cy <= b.max_y + 0.1 AND b.min_z - 0.1 <= a.cz AND a.cz <= b.max_z + 0.1"


def free_slabs_sql(slabs: str) -> str:
    return f"""WITH c AS (SELECT *, (min_x + max_x) / 2 AS cx, (min_y + max_y) / 2 AS cy, (min_z + max_z) / 2 AS cz FROM bld_spaces),
  o AS (SELECT * FROM c a WHERE {slabs} AND NOT EXISTS (SELECT 1 FROM c b WHERE b.seq % 3 <> 0 AND {HOLDS})) """ + greedy_sql(
        f"SELECT b.seq AS earlier, a.seq AS later FROM o a JOIN o b ON b.seq < a.seq AND {HOLDS}", "SELECT id, seq FROM o WHERE seq NOT IN (SELECT item FROM gone)"
    )


@query(f"SELECT * FROM ({free_slabs_sql('seq % 3 = 0')})", "bld_spaces")
def j4_free_slabs(spark, sf_dir):
    rows = view(spark, sf_dir, "bld_spaces").withColumns({"element_id": c("id"), "cx": (c("min_x") + c("max_x")) / 2, "cy": (c("min_y") + c("max_y")) / 2, "cz": (c("min_z") + c("max_z")) / 2})
    return areas.free_slabs(rows.where("seq % 3 = 0"), rows.where("seq % 3 <> 0")).select("id", "seq")


@query(
    END_SQL + """, p AS (SELECT e.id, s.id AS area, row_number() OVER (PARTITION BY e.id ORDER BY s.seq) AS n FROM e JOIN bld_spaces s ON e.lv = s.lv
    AND e.x BETWEEN s.min_x - 0.35 AND s.max_x + 0.35 AND e.y BETWEEN s.min_y - 0.35 AND s.max_y + 0.35 AND e.z BETWEEN s.min_z - 0.35 AND s.max_z + 0.35) SELECT id, area FROM p WHERE n = 1""",
)
def j5_area_of_end(spark, sf_dir):
    return verticals.area_of_end(end_rows(spark, sf_dir), area_rows(spark, sf_dir), verticals.STAIR_REACH).select("id", c("area_id").alias("area"))


@query(
    END_SQL + f""", p AS (SELECT e.id, d.id AS door, {dist('e.x', 'e.y', 'd.x', 'd.y')} AS d, d.seq FROM e JOIN bld_doors d ON e.lv = d.lv),
    r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, seq) AS n FROM p) SELECT id, door, round(d, 6) + 0.0 AS d FROM r WHERE n = 1 AND d <= 3.0""",
)
def j6_door_of_end(spark, sf_dir):
    return verticals.door_of_end(end_rows(spark, sf_dir), door_rows(spark, sf_dir)).select("id", c("r_id").alias("door"), r6(c("d"), "d"))


for _name, _views in (("j5_area_of_end", ("bld_flights", "bld_spaces")), ("j6_door_of_end", ("bld_flights", "bld_doors"))):
    ORACLES[_name] = with_views("", *_views).rstrip() + ", " + ORACLES[_name]


@query(
    """SELECT CAST(flight_id AS VARCHAR) AS from_id, CAST(nxt AS VARCHAR) AS to_id FROM (
    SELECT flight_id, lead(flight_id) OVER (PARTITION BY parent_id ORDER BY sz, flight_id) AS nxt FROM bld_flights) WHERE nxt IS NOT NULL""",
    "bld_flights",
)
def w1_consecutive_flights(spark, sf_dir):
    rows = flight_rows(spark, sf_dir)
    rel = rows.select("model_id", "seq", F.concat(F.lit("P"), c("parent_id").cast("string")).alias("parent_id"), c("element_id").alias("child_id"), F.lit(0).alias("child_pos"))
    stairs = rel.select("model_id", c("parent_id").alias("element_id"), F.lit("IfcStair").alias("ifc_class"))
    return verticals.consecutive_flights(rows, rel, stairs).select("from_id", "to_id")


@query(
    f"""SELECT CAST(a.flight_id AS VARCHAR) AS from_id, CAST(b.flight_id AS VARCHAR) AS to_id, round({dist('a.ex', 'a.ey', 'b.sx', 'b.sy')}, 6) + 0.0 AS d FROM bld_flights a JOIN bld_flights b
    ON a.flight_id <> b.flight_id AND {dist('a.ex', 'a.ey', 'b.sx', 'b.sy')} <= 1.5 AND abs(a.ez - b.sz) <= 0.5""",
    "bld_flights",
)
def j8_near_flights(spark, sf_dir):
    return verticals.near_flights(flight_rows(spark, sf_dir)).select("from_id", "to_id", r6(F.hypot(c("ex") - c("sx"), c("ey") - c("sy")), "d"))


@query("SELECT t.id, s.name AS level FROM bld_transport t JOIN bld_storeys s ON s.elevation BETWEEN t.min_z - 0.5 AND t.min_z + t.dy + 0.5", "bld_transport", "bld_storeys")
def j9_touched_storeys(spark, sf_dir):
    rows = view(spark, sf_dir, "bld_transport").join(levels(spark, sf_dir), "model_id")
    return rows.select("id", F.explode(touched_storeys(c("min_z"), c("min_z") + c("dy"), lifts.STOREY_REACH)).alias("s")).select("id", c("s.name").alias("level"))


@query(
    """SELECT id, coalesce(predefined_type, '') = 'ELEVATOR' OR contains(CASE WHEN id % 4 = 0 THEN concat('a lift ', name) ELSE name END, 'lift') AS semantic,
    CASE WHEN coalesce(predefined_type, '') = 'ELEVATOR' OR id % 4 = 0 THEN dx BETWEEN 0.6 AND 8 AND dy BETWEEN 0.6 AND 8 ELSE dx BETWEEN 0.8 AND 6 AND dy BETWEEN 0.8 AND 6 END AS fits
    FROM bld_transport WHERE coalesce(predefined_type, '') <> 'ESCALATOR'""",
    "bld_transport",
)
def f8_lift_tests(spark, sf_dir):
    rows = view(spark, sf_dir, "bld_transport").withColumn("name", F.when(c("id") % 4 == 0, F.concat(F.lit("a lift "), "name")).otherwise(c("name")))
    rows = rows.where(F.coalesce("predefined_type", F.lit("")) != "ESCALATOR").withColumn("semantic", is_lift_by_text(c("predefined_type"), c("name"), F.lit(None).cast("string")))
    return rows.select("id", "semantic", lifts.sized(c("semantic"), c("dx"), c("dy"), F.lit(3.0)).alias("fits"))


TRANSPORT_SQL = f"""t AS (SELECT *, {TRANSPORT_HEIGHT} AS dz, coalesce(predefined_type, '') = 'ELEVATOR' AS semantic FROM bld_transport WHERE coalesce(predefined_type, '') <> 'ESCALATOR'),
u AS (SELECT t.*, x + dx / 2 AS cx, y + dy / 2 AS cy, s.name AS level, s.elevation, s.seq AS sseq FROM t JOIN bld_storeys s ON s.elevation BETWEEN min_z - 0.5 AND min_z + dz + 0.5
  WHERE CASE WHEN semantic THEN dx BETWEEN 0.6 AND 8 AND dy BETWEEN 0.6 AND 8 AND dz >= 1 ELSE dx BETWEEN 0.8 AND 6 AND dy BETWEEN 0.8 AND 6 AND dz >= 2.2 END),
n AS (SELECT *, count(*) OVER (PARTITION BY id) AS k FROM u)"""


@query()
def j10_door_hits(spark, sf_dir):
    b = building(spark, sf_dir)
    found = lifts.transports(b.elements, base.geometry(b.vertices), levels(spark, sf_dir))
    return lifts.door_hits(found.where(F.size("touched") >= 2), door_rows(spark, sf_dir)).select("element_id", "hits")


ORACLES["j10_door_hits"] = (
    with_views("", "bld_transport", "bld_storeys", "bld_doors").rstrip() + ", " + TRANSPORT_SQL
    + f" SELECT CONCAT('T', CAST(n.id AS VARCHAR)) AS element_id, count(DISTINCT n.level) AS hits FROM n JOIN bld_doors d ON d.lv = n.sseq AND {dist('n.cx', 'n.cy', 'd.x', 'd.y')} <= 5.0 WHERE k >= 2 GROUP BY n.id"
)


def near_cabins_sql(table: str) -> str:
    """Pairs of (id, x, y) within 2.0, by grid."""
    beside = "unnest([floor({0} / 2) - 1, floor({0} / 2), floor({0} / 2) + 1])".format
    return f"""SELECT a.id AS earlier, b.id AS later FROM {table} a
    JOIN (SELECT id, x, y, gx, {beside('y')} AS gy FROM (SELECT id, x, y, {beside('x')} AS gx FROM {table})) b
    ON floor(a.x / 2) = b.gx AND floor(a.y / 2) = b.gy AND a.id < b.id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 4"""


#: Leaders (id, leader) of table, after greedy_sql() of its pairs.
LEADERS_SQL = """, f AS (SELECT later, min(earlier) AS leader FROM pairs WHERE later IN (SELECT item FROM gone) AND earlier NOT IN (SELECT item FROM gone) GROUP BY later),
  led AS (SELECT t.id, coalesce(f.leader, t.id) AS leader FROM {0} t LEFT JOIN f ON f.later = t.id)""".format


@query(
    greedy_sql(
        near_cabins_sql("bld_transport"),
        LEADERS_SQL("bld_transport") + " SELECT CAST(id AS VARCHAR) AS element_id, CAST(leader AS VARCHAR) AS leader FROM led",
    ),
    "bld_transport",
)
def a10_shafts(spark, sf_dir):
    rows = view(spark, sf_dir, "bld_transport").select("model_id", c("id").cast("string").alias("element_id"), c("id").alias("seq"), c("x").alias("cx"), c("y").alias("cy"))
    return lifts.shafts(rows).drop("model_id")


@query()
def b7_lifts(spark, sf_dir):
    b = building(spark, sf_dir)
    found = lifts.lifts(b.elements, base.geometry(b.vertices), levels(spark, sf_dir), door_rows(spark, sf_dir))
    return found.select("element_id", r6(c("x"), "x"), r6(c("y"), "y"), F.array_join("touched.name", "|").alias("levels"))


LIFTS_SQL = (
    "WITH " + TRANSPORT_SQL
    + f""", h AS (SELECT DISTINCT n.id FROM n JOIN bld_doors d ON d.lv = n.sseq AND {dist('n.cx', 'n.cy', 'd.x', 'd.y')} <= 5.0 WHERE k >= 2),
cab AS (SELECT id, cx AS x, cy AS y, level, elevation FROM n WHERE k = 1 AND semantic),
tall AS (SELECT id, any_value(cx) AS x, any_value(cy) AS y, string_agg(level, '|' ORDER BY elevation) AS levels FROM n WHERE k >= 2 AND (semantic OR id IN (SELECT id FROM h)) GROUP BY id) """
    + greedy_sql(
        near_cabins_sql("cab"),
        LEADERS_SQL("cab") + """, spot AS (SELECT leader, avg(x) AS x, avg(y) AS y FROM cab JOIN led USING (id) GROUP BY leader),
  lev AS (SELECT leader, string_agg(level, '|' ORDER BY elevation) AS levels, count(*) AS n FROM (SELECT DISTINCT leader, level, elevation FROM cab JOIN led USING (id)) GROUP BY leader),
  every AS (SELECT * FROM tall UNION ALL SELECT spot.leader, spot.x, spot.y, lev.levels FROM spot JOIN lev USING (leader) WHERE lev.n >= 2)
  SELECT CONCAT('T', CAST(id AS VARCHAR)) AS element_id, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, levels FROM every""",
    )
)
ORACLES["b7_lifts"] = with_views(f"SELECT * FROM ({LIFTS_SQL})", "bld_transport", "bld_storeys", "bld_doors")

LINK_NODES = "SELECT CONCAT('T', CAST(id AS VARCHAR)) AS id, x, y, lv, seq FROM (SELECT o.id, o.x, o.y, s.seq AS lv, o.id AS seq FROM bld_transport o JOIN bld_storeys s ON s.elevation BETWEEN o.min_z AND o.min_z + 4)"


def lift_node_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "bld_transport").join(levels(spark, sf_dir), "model_id")
    rows = rows.select("model_id", F.concat(F.lit("T"), c("id").cast("string")).alias("element_id"), "x", "y", (c("id") * 4096).alias("ord"), touched_storeys(c("min_z"), c("min_z") + 4, 0.0).alias("touched"))
    return lifts.lift_nodes(rows)


@query()
def j11_lift_edges(spark, sf_dir):
    edges = lifts.lift_edges(lift_node_rows(spark, sf_dir), door_rows(spark, sf_dir), area_rows(spark, sf_dir))
    return edges.select("a", "b", "edge_type", "weight", "accessible")


ORACLES["j11_lift_edges"] = (
    with_views("", "bld_transport", "bld_storeys", "bld_doors", "bld_spaces").rstrip()
    + f""", n AS (SELECT concat('T', o.id, '_', s.name) AS id, o.id AS o, o.x, o.y, s.seq AS lv, s.elevation FROM bld_transport o JOIN bld_storeys s ON s.elevation BETWEEN o.min_z AND o.min_z + 4),
w AS (SELECT lag(id) OVER (PARTITION BY o ORDER BY elevation) AS a, id AS b FROM n),
d AS (SELECT n.id, d.id AS door, row_number() OVER (PARTITION BY n.id ORDER BY {dist('n.x', 'n.y', 'd.x', 'd.y')}, d.seq) AS k, {dist('n.x', 'n.y', 'd.x', 'd.y')} AS far FROM n JOIN bld_doors d ON n.lv = d.lv),
l AS (SELECT id, door FROM d WHERE k <= 2 AND far <= 3.0),
s AS (SELECT n.id, s.id AS area, s.seq, sqrt(pow(greatest(s.min_x - n.x, 0, n.x - s.max_x), 2) + pow(greatest(s.min_y - n.y, 0, n.y - s.max_y), 2)) AS far FROM n JOIN bld_spaces s ON n.lv = s.lv WHERE n.id NOT IN (SELECT id FROM l)),
q AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY far, seq) AS k FROM s)
SELECT a, b, 'ascensor' AS edge_type, 1e0 AS weight, TRUE AS accessible FROM w WHERE a IS NOT NULL
UNION ALL SELECT id, door, 'vertical_puerta', 1e0, TRUE FROM l UNION ALL SELECT id, area, 'vertical_espacio', 1e0, TRUE FROM q WHERE k = 1 AND far <= 2.5"""
)

LOW_SQL = """, m AS (SELECT *, min(z) OVER (PARTITION BY element_id) AS base FROM bld_vertices),
g AS (SELECT element_id, round(x, 3) AS kx, round(y, 3) AS ky, min(vseq) AS vseq, arg_min(x, vseq) AS x, arg_min(y, vseq) AS y FROM m WHERE z <= base + 0.25 GROUP BY 1, 2, 3),
n AS (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny, first_value(x) OVER w AS fx, first_value(y) OVER w AS fy, count(*) OVER (PARTITION BY element_id) AS k FROM g WINDOW w AS (PARTITION BY element_id ORDER BY vseq)),
e AS (SELECT element_id, x, y, CASE WHEN nx IS NULL AND k > 2 THEN fx ELSE nx END AS x2, CASE WHEN nx IS NULL AND k > 2 THEN fy ELSE ny END AS y2 FROM n),
o AS (SELECT * FROM e WHERE x2 IS NOT NULL AND sqrt((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y)) > 0.2)"""


def ends_of(coords: str = "coords") -> list[Column]:
    at = lambda i, k: F.element_at(coords, i)[k]
    return [at(1, "x").alias("x"), at(1, "y").alias("y"), at(2, "x").alias("x2"), at(2, "y").alias("y2")]


@query()
def w3_low_edges(spark, sf_dir):
    return outline.low_edges(vertices(spark, sf_dir)).select("element_id", *ends_of())


@query()
def b6_outlines(spark, sf_dir):
    b = building(spark, sf_dir)
    lines = outline.outlines(b.elements, b.vertices, b.rel_boundary, base.geometry(b.vertices), levels(spark, sf_dir))
    return lines.select("level", "element_id", *ends_of())


ORACLES["w3_low_edges"] = with_views("", "bld_vertices").rstrip() + LOW_SQL + " SELECT CONCAT('V', CAST(element_id AS VARCHAR)) AS element_id, x, y, x2, y2 FROM o"
ORACLES["b6_outlines"] = (
    with_views("", "bld_vertices", "bld_storeys").rstrip() + LOW_SQL
    + """ SELECT (SELECT name FROM bld_storeys ORDER BY elevation LIMIT 1) AS level, CONCAT('V', CAST(element_id AS VARCHAR)) AS element_id, x, y, x2, y2 FROM o
WHERE element_id % 8 < 6 AND (element_id % 7 = 0 OR element_id % 4 = 0)"""
)


def edge_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "bld_edges")


@query("SELECT u, v, weight FROM bld_edges WHERE accessible", "bld_edges")
def f18_usable_edges(spark, sf_dir):
    return graph.usable_edges(edge_rows(spark, sf_dir), True).select("u", "v", "weight")


DIST_SQL = """SELECT node, round(cost, 6) + 0.0 AS cost FROM (
  WITH RECURSIVE arcs AS (SELECT u AS a, v AS b, weight FROM bld_edges{0} UNION ALL SELECT v, u, weight FROM bld_edges{0}),
  walk AS (SELECT 'C1' AS node, CAST(0 AS DOUBLE) AS cost, 0 AS hops UNION ALL
    SELECT arcs.b, min(walk.cost + arcs.weight), max(walk.hops) + 1 FROM walk JOIN arcs ON arcs.a = walk.node WHERE walk.hops < 9 GROUP BY arcs.b)
  SELECT node, min(cost) AS cost FROM walk GROUP BY node)"""


def _distances(spark: SparkSession, sf_dir: str, wheelchair: bool) -> DataFrame:
    start = spark.createDataFrame([(M, "C1")], "model_id string, node string")
    found = paths.distances(graph.usable_edges(edge_rows(spark, sf_dir), wheelchair), start)
    return found.select("node", r6(c("cost"), "cost"))


@query(DIST_SQL.format(""), "bld_edges")
def r3_distances(spark, sf_dir):
    return _distances(spark, sf_dir, False)


@query(DIST_SQL.format(" WHERE accessible"), "bld_edges")
def r3_distances_wheelchair(spark, sf_dir):
    return _distances(spark, sf_dir, True)


def graph_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of bld_edges as if they stood somewhere: customers by their nation, the rest each by itself."""
    edges = edge_rows(spark, sf_dir)
    at = edges.where("startswith(u, 'C')").groupBy("model_id", c("u").alias("id")).agg(F.min("v").alias("level"))
    rest = edges.select("model_id", F.explode(F.array("u", "v")).alias("id")).where("NOT startswith(id, 'C')").distinct()
    number = F.substring("id", 2, 20).cast("long")
    return at.unionByName(rest.withColumn("level", c("id"))).withColumns({"x": F.pmod(number, F.lit(64)).cast("double"), "y": F.floor(number / 64).cast("double")})


@query(DIST_SQL.format(""), "bld_edges")
def r3_overlay_distances(spark, sf_dir):
    """As r3_distances, on an overlay of cells."""
    start = spark.createDataFrame([(M, "C1")], "model_id string, node string")
    found = overlay.overlay_distances(edge_rows(spark, sf_dir), start, overlay.cells(graph_places(spark, sf_dir), 256))
    return found.select("node", r6(c("cost"), "cost"))


PATHS_SQL = """SELECT node, CAST(pos AS BIGINT) AS pos, step FROM (
  WITH RECURSIVE arcs AS (SELECT u AS a, v AS b, weight FROM bld_edges UNION ALL SELECT v, u, weight FROM bld_edges),
  walk AS (SELECT 'C1' AS node, {'c': CAST(0 AS DOUBLE), 'h': 0, 'p': ''} AS s UNION ALL
    SELECT b, min({'c': s.c + weight, 'h': s.h + 1, 'p': a}) FROM walk JOIN arcs ON a = node WHERE s.h < 9 GROUP BY b),
  best AS MATERIALIZED (SELECT node, min(s) AS s FROM walk GROUP BY node),
  path AS (SELECT node, node AS step, s.p AS before, s.h AS pos FROM best UNION ALL SELECT path.node, best.node, best.s.p, path.pos - 1 FROM path JOIN best ON best.node = path.before)
  SELECT node, pos, step FROM path)"""


@query(PATHS_SQL, "bld_edges")
def j18_all_paths(spark, sf_dir):
    """The path to every node, from what r3_distances found."""
    start = spark.createDataFrame([(M, "C1")], "model_id string, node string")
    return paths.path_steps(paths.distances(edge_rows(spark, sf_dir), start)).select("node", "pos", "step")


def request_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From each nation to the region one further, both modes."""
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet")
    name = lambda p, col: F.concat(F.lit(p), col.cast("string"))
    return nations.select(
        F.lit(M).alias("model_id"), c("n_nationkey").cast("long").alias("request_id"),
        name("N", c("n_nationkey")).alias("origin"), name("R", (c("n_regionkey") + 1) % 5).alias("destination"), (c("n_nationkey") % 2 == 0).alias("wheelchair"),
    )


def route_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    edges = edge_rows(spark, sf_dir)
    ids = edges.select("model_id", F.explode(F.array("u", "v")).alias("id")).distinct()
    nodes = ids.select("model_id", "id", F.lit("n").alias("name"), F.lit("t").alias("type"), F.lit("l").alias("level"), *(F.lit(0.0).alias(k) for k in "xyz"))
    return paths.routes(request_rows(spark, sf_dir), nodes, edges), nodes


ROUTE_SQL = """SELECT CAST(n_nationkey AS BIGINT) AS request_id, n_nationkey % 2 = 1 OR n_nationkey % 6 <> 0 AS found,
  CASE WHEN n_nationkey % 2 = 1 OR n_nationkey % 6 <> 0 THEN 2e0 END AS total_weight, CASE WHEN n_nationkey % 2 = 1 OR n_nationkey % 6 <> 0 THEN 3 ELSE 0 END AS n_nodes,
  CASE WHEN n_nationkey % 2 = 1 THEN 'Ruta encontrada · 3 nodos · coste 2.0' WHEN n_nationkey % 6 <> 0 THEN 'Ruta ♿ encontrada · 3 nodos · coste 2.0'
    ELSE 'No existe ruta accesible (sin escaleras) entre los nodos indicados.' END AS message FROM nation"""


@query(ROUTE_SQL)
def k3_route_responses(spark, sf_dir):
    found, nodes = route_rows(spark, sf_dir)
    return route_responses(found, nodes).select("request_id", "found", "total_weight", F.size("path_nodes").alias("n_nodes"), "message")


@query(
    """SELECT CAST(n_nationkey AS BIGINT) AS request_id, unnest([0, 1, 2]) AS pos, unnest([concat('N', n_nationkey), concat('R', n_regionkey), concat('R', (n_regionkey + 1) % 5)]) AS id
    FROM nation WHERE n_nationkey % 2 = 1 OR n_nationkey % 6 <> 0""",
)
def j18_path_nodes(spark, sf_dir):
    return route_rows(spark, sf_dir)[0].select("request_id", F.posexplode("path").alias("pos", "id"))


@query(
    """, e AS (SELECT least(u, v) AS a, greatest(u, v) AS b, weight, accessible, row_number() OVER (ORDER BY u, v, weight) AS n FROM bld_edges UNION ALL SELECT least(u, v), greatest(u, v), weight + 1, FALSE, 1000000 + row_number() OVER (ORDER BY u, v, weight) FROM bld_edges WHERE accessible)
    SELECT a AS u, b AS v, arg_max(weight, n) AS weight, arg_max(accessible, n) AS accessible, CASE WHEN left(a, 1) = left(b, 1) THEN left(a, 1) ELSE concat(left(a, 1), '|', left(b, 1)) END AS levels FROM e GROUP BY a, b""",
)
def d5_assemble_edges(spark, sf_dir):
    rows = edge_rows(spark, sf_dir).select("model_id", c("v").alias("a"), c("u").alias("b"), "weight", "accessible")
    twice = rows.withColumn("ord", F.lit(0)).unionByName(rows.where("accessible").withColumns({"weight": c("weight") + 1, "accessible": F.lit(False), "ord": F.lit(1)}))
    point = F.struct(*(F.lit(0.0).alias(k) for k in "xyz"))
    twice = twice.withColumns({"edge_type": F.lit("camino"), "coords": F.array(point, point)})
    ids = rows.select("model_id", F.explode(F.array("a", "b")).alias("id")).distinct()
    nodes = ids.select("model_id", "id", F.substring("id", 1, 1).alias("level"), F.ascii("id").cast("long").alias("seq"))
    made = graph.assemble_edges(twice, nodes)
    return made.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "weight", "accessible", "levels")


ORACLES["d5_assemble_edges"] = with_views("", "bld_edges").rstrip() + ORACLES["d5_assemble_edges"]

SNAPPED = "(SELECT arg_min({0}, (abs(elevation - {1}), elevation, seq)) FROM bld_storeys)".format
#: Both ends (name, z) of rows of {0} with sx .. ez as nodes of type {1}; {2}, {3}: their names, {4}: accessible, {5}: z of an end.
ENDS_SQL = " UNION ALL ".join(
    f"""SELECT concat(element_id, '_{end}') AS id, '{{1}}' AS type, '{{{n}}}' AS name, {SNAPPED('name', f'{p}z')} AS level, {p}x AS x, {p}y AS y, {{5}} AS z, {{4}} AS accessible, CAST(NULL AS DOUBLE) AS width FROM {{0}}""".replace("{5}", f"{{{5 + i}}}")
    for i, (p, end, n) in enumerate((("s", "START", 2), ("e", "END", 3)))
).format
#: All nodes of the building, in parts that each have their own views.
NODE_PARTS = [
    """SELECT id, 'Habitacion' AS type, 'Estancia' AS name, l.name AS level, (min_x + max_x) / 2 AS x, (min_y + max_y) / 2 AS y, l.elevation AS z, TRUE AS accessible, CAST(NULL AS DOUBLE) AS width
    FROM bld_spaces s JOIN bld_storeys l ON s.lv = l.seq WHERE s.seq % 3 <> 0""",
    """SELECT id, 'Puerta' AS type, 'Puerta' AS name, l.name AS level, x, y, l.elevation AS z, CASE WHEN width > 0 THEN width >= 0.85 ELSE TRUE END AS accessible, CASE WHEN width <> 0 THEN round_even(width, 3) END AS width
    FROM bld_doors d JOIN bld_storeys l ON d.lv = l.seq""",
    f"""SELECT c.id, 'Suelo' AS type, 'Suelo/Pasillo' AS name, l.name AS level, cx AS x, cy AS y, l.elevation AS z, TRUE AS accessible, CAST(NULL AS DOUBLE) AS width
    FROM ({free_slabs_sql('seq % 3 = 0 AND seq % 12 <> 0')}) k JOIN (SELECT id, lv, (min_x + max_x) / 2 AS cx, (min_y + max_y) / 2 AS cy FROM bld_spaces) c USING (id) JOIN bld_storeys l ON c.lv = l.seq""",
    ENDS_SQL("(SELECT CONCAT('F', CAST(flight_id AS VARCHAR)) AS element_id, * FROM bld_flights)", "Escalera", "Escalera Inicio", "Escalera Fin", "FALSE", "sz", "ez"),
    ENDS_SQL(f"({RAMP_SQL})", "Rampa", "Rampa Inicio", "Rampa Fin", "TRUE", SNAPPED("elevation", "sz"), SNAPPED("elevation", "ez")),
    f"""SELECT concat(element_id, '_', level) AS id, 'Ascensor' AS type, 'Ascensor' AS name, level, x, y, l.elevation AS z, TRUE AS accessible, CAST(NULL AS DOUBLE) AS width
    FROM (SELECT element_id, x, y, unnest(string_split(levels, '|')) AS level FROM ({LIFTS_SQL})) JOIN bld_storeys l ON level = l.name""",
]


@query(
    "SELECT id, type, name, level, round_even(x, 4) + 0.0 AS x, round_even(y, 4) + 0.0 AS y, round_even(z, 4) + 0.0 AS z, accessible, width FROM (" + " UNION ALL ".join(f"SELECT * FROM ({p})" for p in NODE_PARTS) + ")",
    *VIEWS,
)
def p9_shown_nodes(spark, sf_dir):
    return payload.shown_nodes(build_nodes(building(spark, sf_dir))).drop("model_id", "seq").withColumns({k: c(k) + F.lit(0.0) for k in "xyz"})


@query()
def b8_graph_nodes(spark, sf_dir):
    return build_nodes(building(spark, sf_dir)).drop("model_id")


#: All edges (a, b, their levels and places among the nodes, and the path) of the building, from those of its parts.
EDGES_SQL = f""", {FRAMES_SQL},
area AS MATERIALIZED (SELECT s.id, s.seq, s.lv, l.name AS level, l.elevation AS z, (min_x + max_x) / 2 AS x, (min_y + max_y) / 2 AS y, min_x, min_y, min_z, max_x, max_y, max_z, CASE WHEN s.seq % 3 = 0 THEN 2 ELSE 1 END AS stage
  FROM bld_spaces s JOIN bld_storeys l ON s.lv = l.seq WHERE s.seq % 3 <> 0 OR s.id IN (SELECT id FROM ({free_slabs_sql('seq % 3 = 0 AND seq % 12 <> 0')}))),
flight AS (SELECT concat('F', flight_id) AS id, flight_id AS seq, parent_id, sx, sy, sz, ex, ey, ez, 4 AS stage, FALSE AS flat FROM bld_flights),
ramp AS (SELECT element_id AS id, CAST(substr(element_id, 2) AS BIGINT) AS seq, 0 AS parent_id, sx, sy, sz, ex, ey, ez, 7 AS stage, TRUE AS flat FROM ({RAMP_SQL})),
run AS MATERIALIZED (SELECT *, {SNAPPED('name', 'sz')} AS level_s, {SNAPPED('name', 'ez')} AS level_e, {SNAPPED('elevation', 'sz')} AS elev_s, {SNAPPED('elevation', 'ez')} AS elev_e FROM (SELECT * FROM flight UNION ALL SELECT * FROM ramp)),
fin AS MATERIALIZED (SELECT concat(id, '_START') AS id, stage, seq, 0 AS sub, level_s AS level, sx AS x, sy AS y, CASE WHEN flat THEN elev_s ELSE sz END AS z, elev_s AS probe, CASE WHEN flat THEN 0.40 ELSE 0.35 END AS reach FROM run
  UNION ALL SELECT concat(id, '_END'), stage, seq, 1, level_e, ex, ey, CASE WHEN flat THEN elev_e ELSE ez END, elev_e, CASE WHEN flat THEN 0.40 ELSE 0.35 END FROM run),
lift AS MATERIALIZED (SELECT element_id, x, y, string_split(levels, '|') AS levels FROM ({LIFTS_SQL})),
stop AS MATERIALIZED (SELECT concat(element_id, '_', level) AS id, element_id, 8 AS stage, CAST(substr(element_id, 2) AS BIGINT) AS seq, pos AS sub, level, x, y, l.elevation AS z
  FROM (SELECT element_id, x, y, unnest(levels) AS level, unnest(range(len(levels))) AS pos FROM lift) JOIN bld_storeys l ON l.name = level),
da AS (SELECT d.id AS door, a.id AS area, row_number() OVER (PARTITION BY d.id ORDER BY CASE WHEN d.x BETWEEN a.min_x - 0.65 AND a.max_x + 0.65 AND d.y BETWEEN a.min_y - 0.65 AND a.max_y + 0.65 THEN 0.0
    ELSE sqrt(pow(greatest(a.min_x - d.x, 0, d.x - a.max_x), 2) + pow(greatest(a.min_y - d.y, 0, d.y - a.max_y), 2)) END, a.stage, a.seq) AS k
  FROM door d JOIN area a ON d.lv = a.lv AND (d.x BETWEEN a.min_x - 0.65 AND a.max_x + 0.65 AND d.y BETWEEN a.min_y - 0.65 AND a.max_y + 0.65
    OR sqrt(pow(greatest(a.min_x - d.x, 0, d.x - a.max_x), 2) + pow(greatest(a.min_y - d.y, 0, d.y - a.max_y), 2)) <= 1.10)),
ea AS (SELECT id, area FROM (SELECT f.id, a.id AS area, row_number() OVER (PARTITION BY f.id ORDER BY a.stage, a.seq) AS k FROM fin f JOIN area a ON a.level = f.level
  AND f.x BETWEEN min_x - reach AND max_x + reach AND f.y BETWEEN min_y - reach AND max_y + reach AND probe BETWEEN min_z - reach AND max_z + reach) WHERE k = 1),
ed AS (SELECT id, door FROM (SELECT f.id, d.id AS door, row_number() OVER (PARTITION BY f.id ORDER BY {dist('f.x', 'f.y', 'd.x', 'd.y')}, d.seq) AS k, {dist('f.x', 'f.y', 'd.x', 'd.y')} AS far
  FROM fin f JOIN door d ON d.level = f.level WHERE f.id NOT IN (SELECT id FROM ea)) WHERE k = 1 AND far <= 3.0),
ld AS (SELECT id, door FROM (SELECT s.id, d.id AS door, row_number() OVER (PARTITION BY s.id ORDER BY {dist('s.x', 's.y', 'd.x', 'd.y')}, d.seq) AS k, {dist('s.x', 's.y', 'd.x', 'd.y')} AS far FROM stop s JOIN door d ON d.level = s.level) WHERE k <= 2 AND far <= 3.0),
la AS (SELECT id, area FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY far, stage, seq) AS k FROM (SELECT s.id, a.id AS area, a.stage, a.seq, sqrt(pow(greatest(min_x - s.x, 0, s.x - max_x), 2) + pow(greatest(min_y - s.y, 0, s.y - max_y), 2)) AS far
  FROM stop s JOIN area a ON a.level = s.level WHERE s.id NOT IN (SELECT id FROM ld))) WHERE k = 1 AND far <= 2.5),
near_flight AS (SELECT a.id AS f, b.id AS t FROM flight a JOIN flight b ON a.id <> b.id AND {dist('a.ex', 'a.ey', 'b.sx', 'b.sy')} <= 1.5 AND abs(a.ez - b.sz) <= 0.5),
next_flight AS (SELECT f, t FROM (SELECT id AS f, lead(id) OVER (PARTITION BY parent_id ORDER BY sz, seq) AS t FROM flight) WHERE t IS NOT NULL),
landing AS (SELECT f, t FROM next_flight UNION SELECT f, t FROM near_flight),
spot AS MATERIALIZED (SELECT id, level, x, y, z, stage, seq, 0 AS sub FROM area UNION ALL SELECT id, level, x, y, z, 3, seq, 0 FROM door UNION ALL SELECT id, level, x, y, z, stage, seq, sub FROM fin UNION ALL SELECT id, level, x, y, z, stage, seq, sub FROM stop),
-- From a door along its normal to (tx, ty); turned: the way back.
bent AS (SELECT d.id AS a, t.id AS b, 'puerta_espacio' AS type, CASE WHEN open THEN 1.0 ELSE 999999.0 END AS weight, open, FALSE AS turned, d.z, d.x, d.y, t.x AS tx, t.y AS ty, (t.x - d.x) * nx + (t.y - d.y) * ny AS k, nx, ny FROM da JOIN door d ON d.id = da.door JOIN area t ON t.id = da.area WHERE da.k <= 2
  UNION ALL SELECT t.id, d.id, 'vertical_puerta', 1.0, TRUE, TRUE, t.z, d.x, d.y, t.x, t.y, (t.x - d.x) * nx + (t.y - d.y) * ny, nx, ny FROM (SELECT * FROM ed UNION ALL SELECT * FROM ld) l JOIN door d ON d.id = l.door JOIN spot t ON t.id = l.id
  UNION ALL SELECT t.id, a.id, 'vertical_espacio', 1.0, TRUE, FALSE, t.z, t.x, t.y, a.x, a.y, a.x - t.x, 1, 0 FROM (SELECT * FROM ea UNION ALL SELECT * FROM la) l JOIN spot t ON t.id = l.id JOIN area a ON a.id = l.area),
corner AS (SELECT *, x + k * nx AS cx, y + k * ny AS cy FROM bent),
path AS (SELECT a, b, type, weight, open, turned, CASE WHEN f1 AND f2 THEN [[x, y, z], [cx, cy, z], [tx, ty, z]] WHEN f1 THEN [[x, y, z], [cx, cy, z]] ELSE [[x, y, z], [tx, ty, z]] END AS p
  FROM (SELECT *, {dist('cx', 'cy', 'x', 'y')} > 1e-6 AS f1, {dist('cx', 'cy', 'tx', 'ty')} > 1e-6 AS f2 FROM corner)),
edge AS MATERIALIZED (SELECT a, b, type, weight, open, CASE WHEN turned THEN list_reverse(p) ELSE p END AS p FROM path
  UNION ALL SELECT concat(id, '_START'), concat(id, '_END'), 'escalera', 999999.0, FALSE, [[sx, sy, sz], [ex, ey, ez]] FROM run WHERE NOT flat
  UNION ALL SELECT concat(id, '_START'), concat(id, '_END'), 'rampa', 1.2, TRUE, [[sx, sy, elev_s], [ex, ey, elev_e]] FROM run WHERE flat
  UNION ALL SELECT concat(f, '_END'), concat(t, '_START'), 'escalera_rellano', greatest(1.2 * {dist('a.ex', 'a.ey', 'b.sx', 'b.sy')}, 0.5), FALSE, [[a.ex, a.ey, a.ez], [b.sx, b.sy, b.sz]] FROM landing JOIN flight a ON a.id = f JOIN flight b ON b.id = t
  UNION ALL SELECT below, id, 'ascensor', 1.0, TRUE, [[x, y, zb], [x, y, z]] FROM (SELECT *, lag(id) OVER w AS below, lag(z) OVER w AS zb FROM stop WINDOW w AS (PARTITION BY element_id ORDER BY sub)) WHERE below IS NOT NULL),
whole AS MATERIALIZED (SELECT CASE WHEN (m.stage, m.seq, m.sub) < (n.stage, n.seq, n.sub) THEN a ELSE b END AS u, CASE WHEN (m.stage, m.seq, m.sub) < (n.stage, n.seq, n.sub) THEN b ELSE a END AS v, type, CAST(weight AS DOUBLE) AS weight, open,
  CASE WHEN m.level = n.level THEN m.level ELSE concat(least(m.level, n.level), '|', greatest(m.level, n.level)) END AS levels, p FROM edge JOIN spot m ON m.id = a JOIN spot n ON n.id = b)"""
WHOLE_SQL = with_views("", "bld_vertices", "bld_doors", "bld_storeys", "bld_spaces", "bld_flights", "bld_transport").rstrip() + AXIS_SQL + EDGES_SQL


def point_columns(coords: str = "coords", at: int = 3) -> list[Column]:
    """n_points, and x1 .. z3 of the first points."""
    spot = lambda i, j: F.get(F.get(coords, F.lit(i)), F.lit(j))
    return [F.size(coords).alias("n_points"), *(r6(spot(i, j), f"{k}{i + 1}") for i in range(at) for j, k in enumerate("xyz"))]


@query()
def b8_graph_edges(spark, sf_dir):
    nodes, edges = build_ways(building(spark, sf_dir))
    shown = payload.shown_edges(edges, nodes)
    return shown.select("u", "v", "type", "accessible", "levels", r6(c("weight"), "weight"), *point_columns())


ORACLES["b8_graph_edges"] = WHOLE_SQL + " SELECT u, v, type, open AS accessible, levels, round(weight, 6) + 0.0 AS weight, len(p) AS n_points, " + ", ".join(f"round(p[{i}][{j}], 6) + 0.0 AS {k}{i}" for i in (1, 2, 3) for j, k in enumerate("xyz", 1)) + " FROM whole"


@query()
def a12_summary(spark, sf_dir):
    return build_summary(building(spark, sf_dir)).drop("model_id")


ORACLES["a12_summary"] = WHOLE_SQL + """ SELECT CASE stage WHEN 1 THEN 'areas' WHEN 2 THEN 'areas' WHEN 3 THEN 'puerta' WHEN 4 THEN 'escalera' WHEN 7 THEN 'rampa' ELSE 'ascensor' END AS what,
  count(DISTINCT CASE WHEN stage > 3 THEN regexp_replace(id, '_[^_]*$', '') ELSE id END) AS n FROM spot GROUP BY 1 UNION ALL SELECT 'nodes', count(*) FROM spot UNION ALL SELECT 'edges', count(*) FROM whole"""


@query()
def p11_floor_plans(spark, sf_dir):
    made = view_outlines(spark, sf_dir)
    pieces = payload.floor_plans(made).select("level", F.size("lines").cast("long").alias("n"), F.aggregate("lines", F.lit(0.0), lambda a, l: a + l[0][0]).alias("x"))
    return pieces.groupBy("level").agg(F.sum("n").alias("n_lines"), r6(F.sum("x"), "sum_x"))


def view_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = building(spark, sf_dir)
    return outline.outlines(b.elements, b.vertices, b.rel_boundary, base.geometry(b.vertices), levels(spark, sf_dir))


ORACLES["p11_floor_plans"] = f"SELECT level, count(*) AS n_lines, round(sum(x), 6) + 0.0 AS sum_x FROM ({ORACLES['b6_outlines']}) GROUP BY level"


@query()
def p13_outline_layer(spark, sf_dir):
    layer = export.outline_layer(view_outlines(spark, sf_dir), view(spark, sf_dir, "bld_storeys"))
    return layer.select("level", "tipo", *ends_of("geometry"), F.element_at("geometry", 1)["z"].alias("z"))


ORACLES["p13_outline_layer"] = f"SELECT level, 'PlantaBase' AS tipo, x, y, x2, y2, 0e0 AS z FROM ({ORACLES['b6_outlines']})"


@query()
def r3_route_through_building(spark, sf_dir):
    """From the foot of every flight to the head of the last one, every other one by wheelchair, in the whole graph."""
    nodes, edges = build_ways(building(spark, sf_dir))
    flights = view(spark, sf_dir, "bld_flights")
    last = flights.agg(F.concat(F.lit("F"), F.max("flight_id").cast("string"), F.lit("_END")).alias("destination"))
    asked = flights.select("model_id", c("flight_id").alias("request_id"), F.concat(F.lit("F"), c("flight_id").cast("string"), F.lit("_START")).alias("origin"), (c("flight_id") % 2 == 1).alias("wheelchair")).join(F.broadcast(last))
    found = paths.routes(asked, nodes, edges)
    return found.select("request_id", "status", F.coalesce(F.try_element_at("path", F.lit(1)), F.lit("")).alias("starts"), F.coalesce(F.try_element_at("path", F.lit(-1)), F.lit("")).alias("ends"), r6(c("total_weight"), "total_weight"))


#: Edges have no direction, so the ways from the last flight's head are those that were asked for.
ORACLES["r3_route_through_building"] = WHOLE_SQL + """, goal AS (SELECT concat('F', max(flight_id), '_END') AS id FROM bld_flights),
found AS MATERIALIZED (SELECT by_chair, node, min(cost) AS cost FROM (WITH RECURSIVE arcs AS MATERIALIZED (SELECT u AS x, v AS y, weight, open FROM whole UNION ALL SELECT v, u, weight, open FROM whole),
  walk AS (SELECT unnest([FALSE, TRUE]) AS by_chair, id AS node, CAST(0 AS DOUBLE) AS cost, 0 AS hops FROM goal
    UNION ALL SELECT by_chair, y, min(cost + weight), max(hops) + 1 FROM walk JOIN arcs ON x = node AND (open OR NOT by_chair) WHERE hops < 120 GROUP BY by_chair, y) SELECT * FROM walk) GROUP BY by_chair, node)
SELECT CAST(flight_id AS BIGINT) AS request_id, CASE WHEN cost IS NULL THEN 'no_route' ELSE 'found' END AS status, CASE WHEN cost IS NULL THEN '' ELSE concat('F', flight_id, '_START') END AS starts,
  CASE WHEN cost IS NULL THEN '' ELSE goal.id END AS ends, round(cost, 6) + 0.0 AS total_weight
FROM bld_flights CROSS JOIN goal LEFT JOIN found ON found.node = concat('F', flight_id, '_START') AND found.by_chair = (flight_id % 2 = 1)"""


QUERIES |= models.QUERIES | details.QUERIES
ORACLES |= models.ORACLES | details.ORACLES
