"""Queries over odd rows derived from the driver tables: repeated ids and names, models without storeys, containers, fallbacks, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayhall.bindings.views import M, view, with_views
from wayhall.operators import base, graph, outline
from wayhall.plans.checkpoint import folder
from wayhall.plans.spatial import storey_list
from wayhall.sinks import export, payload
from wayhall.streaming import upserts

c = F.col


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text(prefix: str, col: str) -> Column:
    return F.concat(F.lit(prefix), c(col).cast("string"))


def spot(x: Column, y: Column, z: Column) -> Column:
    return F.struct(*(v.cast("double").alias(k) for k, v in zip("xyz", (x, y, z), strict=True)))


D7 = """SELECT concat('m', n_regionkey % 3) AS model_id, concat('Nivel ', n_nationkey % 4) AS name, CAST(arg_max(CASE WHEN n_nationkey % 5 = 0 THEN 0 ELSE n_nationkey * 4 END, n_nationkey) AS DOUBLE) AS elevation,
    CAST(min(n_nationkey) AS BIGINT) AS seq FROM nation GROUP BY 1, 2 UNION ALL SELECT DISTINCT concat('p', p_size), 'Nivel 0', 0e0, CAST(0 AS BIGINT) FROM part"""


def d7_storeys_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Storeys of repeated names (the first one's place, the last one's height), some without a height, and models without any."""
    nations = table(spark, sf_dir, "nation").select(
        F.concat(F.lit("m"), (c("n_regionkey") % 3).cast("string")).alias("model_id"), c("n_nationkey").cast("long").alias("seq"), F.lit("IfcBuildingStorey").alias("ifc_class"),
        F.concat(F.lit(" Nivel "), (c("n_nationkey") % 4).cast("string")).alias("name"), F.when(c("n_nationkey") % 5 != 0, (c("n_nationkey") * 4).cast("string")).alias("elevation"),
    )
    rest = table(spark, sf_dir, "part").select(text("p", "p_size").alias("model_id"), c("p_partkey").cast("long").alias("seq"), F.lit("IfcSpace").alias("ifc_class"), F.lit("a").alias("name"), F.lit("1").alias("elevation"))
    return base.storeys(nations.unionByName(rest))


D1 = """SELECT CAST(l_orderkey AS VARCHAR) AS element_id, CAST(min(CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey * 1000 + l_suppkey) AS BIGINT) AS seq, CAST(count(*) AS BIGINT) AS scanned FROM lineitem GROUP BY l_orderkey"""


def d1_first_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements that are scanned once for each line item; the first counts."""
    rows = table(spark, sf_dir, "lineitem").select(F.lit(M).alias("model_id"), c("l_orderkey").cast("string").alias("element_id"), (c("l_linenumber") * F.lit(1_000_000_000).cast("long") + c("l_partkey") * 1000 + c("l_suppkey")).alias("seq"))
    scanned = rows.groupBy("element_id").agg(F.count(F.lit(1)).alias("scanned"))
    return base.first_scan(rows).select("element_id", "seq").join(scanned, "element_id")


D6 = """SELECT concat('C', o_custkey) AS id, CAST(min(o_orderkey) AS BIGINT) AS seq, arg_max(o_orderpriority, o_orderkey) AS name, arg_max(CAST(o_orderkey % 64 AS DOUBLE) / 4, o_orderkey) AS x, arg_max(o_orderstatus <> 'F', o_orderkey) AS accessible FROM orders GROUP BY o_custkey"""


def d6_upserted_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes that are written once for each order of a customer: the last one's attributes at the first one's place."""
    rows = table(spark, sf_dir, "orders").select(
        F.lit(M).alias("model_id"), text("C", "o_custkey").alias("id"), c("o_orderkey").cast("long").alias("ord"), c("o_orderpriority").alias("name"), ((c("o_orderkey") % 64).cast("double") / 4).alias("x"), (c("o_orderstatus") != "F").alias("accessible")
    )
    return graph.upsert_nodes(rows).select("id", "seq", "name", "x", "accessible")


F20 = """SELECT least(a, b) AS a, greatest(a, b) AS b, CAST(min(n) AS BIGINT) AS seq, arg_max(w, n) AS weight FROM (SELECT concat('P', l_partkey % 50) AS a, concat('S', l_suppkey % 50) AS b, l_orderkey * 100000 + l_linenumber * 10000 + l_partkey % 10000 AS n, l_quantity AS w, l_linenumber % 3 AS points FROM lineitem)
  WHERE points >= 2 GROUP BY 1, 2"""


def f20_edges_with_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of none, one or two coordinates; those of fewer than two don't count. Pairs come in both directions."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.lit(M).alias("model_id"), F.concat(F.lit("P"), (c("l_partkey") % 50).cast("string")).alias("p"), F.concat(F.lit("S"), (c("l_suppkey") % 50).cast("string")).alias("s"), "l_linenumber", c("l_quantity").alias("weight"),
        (c("l_orderkey").cast("long") * 100000 + c("l_linenumber") * 10000 + c("l_partkey") % 10000).alias("ord"), F.slice(F.array(*(spot(F.lit(0), F.lit(0), F.lit(0)),) * 2), F.lit(1), c("l_linenumber") % 3).alias("coords"),
    )
    turned = c("l_linenumber") % 2 == 0
    rows = rows.withColumns({"a": F.when(turned, c("p")).otherwise(c("s")), "b": F.when(turned, c("s")).otherwise(c("p"))}).drop("p", "s", "l_linenumber")
    return graph.upsert_edges(rows).select("a", "b", "seq", "weight")


def odd_walls(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Walls, vertices, boundaries and storeys of two models: in a, orders of even number, some are external or bound a space; in b none.

    Some walls stand in a storey by name, one that is unknown among them, some in a building, some nowhere.
    """
    points = view(spark, sf_dir, "bld_vertices").withColumns({"model_id": F.when(c("element_id") % 2 == 0, "a").otherwise("b"), "z": c("z") + 5 * (c("element_id") % 3)})
    points = points.select("model_id", text("V", "element_id").alias("element_id"), c("vseq").cast("int").alias("vseq"), "x", "y", "z", c("element_id").alias("n"))
    kind = F.when(c("n") % 10 < 5, "IfcWall").when(c("n") % 10 < 9, "IfcWallStandardCase").otherwise("IfcCurtainWall")
    held = F.when(c("n") % 7 < 2, "IfcBuildingStorey").when(c("n") % 7 == 2, "IfcBuilding")
    walls = points.select("model_id", "element_id", "n").distinct().select(
        "model_id", "element_id", c("n").alias("seq"), kind.alias("ifc_class"), ((c("n") % 4 == 0) & (c("model_id") == "a")).alias("is_external"),
        held.alias("container_class"), F.when(c("n") % 7 == 0, " ASIA ").when(c("n") % 7 == 1, "Otro").otherwise("AFRICA").alias("container_name"),
    )
    bounds = walls.where("model_id = 'a' AND seq % 6 = 0").select("model_id", "seq", "element_id")
    storeys = view(spark, sf_dir, "bld_storeys").drop("model_id").join(F.broadcast(spark.createDataFrame([("a",), ("b",)], "model_id string")))
    return walls, points.drop("n"), bounds, storeys


U4_LOW = """, m AS (SELECT element_id, vseq, x, y, z + 5 * (element_id % 3) AS z, min(z + 5 * (element_id % 3)) OVER (PARTITION BY element_id) AS base FROM bld_vertices),
g AS (SELECT element_id, round(x, 3) AS kx, round(y, 3) AS ky, min(vseq) AS vseq, arg_min(x, vseq) AS x, arg_min(y, vseq) AS y, any_value(base) AS base FROM m WHERE z <= base + 0.25 GROUP BY 1, 2, 3),
n AS (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny, first_value(x) OVER w AS fx, first_value(y) OVER w AS fy, count(*) OVER (PARTITION BY element_id) AS k FROM g WINDOW w AS (PARTITION BY element_id ORDER BY vseq)),
e AS (SELECT element_id, base, x, y, CASE WHEN nx IS NULL AND k > 2 THEN fx ELSE nx END AS x2, CASE WHEN nx IS NULL AND k > 2 THEN fy ELSE ny END AS y2 FROM n),
o AS (SELECT CASE WHEN element_id % 2 = 0 THEN 'a' ELSE 'b' END AS model_id, CASE WHEN element_id % 7 = 0 THEN 'ASIA' WHEN element_id % 7 = 1 THEN 'Otro' ELSE (SELECT arg_min(name, (abs(elevation - base), elevation, seq)) FROM bld_storeys) END AS level,
  concat('V', element_id) AS element_id, x, y, x2, y2 FROM e WHERE x2 IS NOT NULL AND sqrt((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y)) > 0.2
  AND CASE WHEN element_id % 2 = 0 THEN element_id % 6 = 0 OR element_id % 4 = 0 AND element_id % 10 < 9 ELSE element_id % 10 < 9 END)"""
U4 = with_views("", "bld_vertices", "bld_storeys").rstrip() + U4_LOW + " SELECT * FROM o"


def _lines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    walls, points, bounds, storeys = odd_walls(spark, sf_dir)
    return outline.outlines(walls, points, bounds, base.geometry(points), storey_list(storeys)), storeys


def u4_outline_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlines of a model with external and bounding walls, and of one without, which gets all its walls."""
    at = lambda i, k: F.element_at("coords", i)[k]
    return _lines(spark, sf_dir)[0].select("model_id", "level", "element_id", at(1, "x").alias("x"), at(1, "y").alias("y"), at(2, "x").alias("x2"), at(2, "y").alias("y2"))


J16 = U4.replace("SELECT * FROM o", "SELECT model_id, level, coalesce(s.elevation, 0e0) AS z, count(*) AS n FROM o LEFT JOIN bld_storeys s ON s.name = level GROUP BY 1, 2, 3")


def j16_outline_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heights of the outline layer, by level; 0 for a level that is no storey."""
    lines, storeys = _lines(spark, sf_dir)
    layer = export.outline_layer(lines, storeys)
    return layer.groupBy("model_id", "level", F.element_at("geometry", 1)["z"].alias("z")).agg(F.count(F.lit(1)).alias("n"))


def route_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """bld_edges as a graph of places: some edges without flag, type, levels or path."""
    edges = view(spark, sf_dir, "bld_edges")
    nodes = edges.select("model_id", F.explode(F.array("u", "v")).alias("id")).distinct()
    n = F.substring("id", 2, 20).cast("long")
    nodes = nodes.select(
        "model_id", "id", n.alias("seq"), F.when(n % 3 != 0, F.lit("Puerta")).alias("name"), F.substring("id", 1, 1).alias("type"), F.when(n % 4 != 0, F.lit("P0")).alias("level"),
        *((n % k).cast("double").alias(a) for a, k in (("x", 64), ("y", 32), ("z", 8))), F.when(n % 5 != 0, n % 2 == 0).alias("accessible"),
    )
    k = F.substring("u", 2, 20).cast("long")
    path = F.when(k % 3 != 0, F.array(spot(k, k % 7, F.lit(1)), spot(k % 5, F.lit(2), k)))
    return nodes, edges.select("model_id", "u", "v", k.alias("seq"), F.when(k % 4 != 0, F.lit("rampa")).alias("edge_type"), F.when(k % 6 != 0, c("weight")).alias("weight"), F.when(k % 5 != 1, c("accessible")).alias("accessible"), F.when(k % 7 != 0, F.lit("P0")).alias("levels"), path.alias("coords"))


GRAPH = """, e AS (SELECT u, v, CAST(substr(u, 2) AS BIGINT) AS k, CAST(substr(v, 2) AS BIGINT) AS j, weight, accessible FROM bld_edges),
f AS (SELECT *, [CASE WHEN k % 3 <> 0 THEN CAST(k AS DOUBLE) ELSE k % 64 END, CASE WHEN k % 3 <> 0 THEN k % 7 ELSE k % 32 END, CASE WHEN k % 3 <> 0 THEN 1 ELSE k % 8 END,
  CASE WHEN k % 3 <> 0 THEN k % 5 ELSE j % 64 END, CASE WHEN k % 3 <> 0 THEN 2 ELSE j % 32 END, CASE WHEN k % 3 <> 0 THEN k ELSE j % 8 END] AS p FROM e)"""
POINTS = ", ".join(f"CAST(p[{i + 1}] AS DOUBLE) AS {n}" for i, n in enumerate(("x1", "y1", "z1", "x2", "y2", "z2")))
P10 = with_views("", "bld_edges").rstrip() + GRAPH + f""" SELECT u, v, CASE WHEN k % 4 <> 0 THEN 'rampa' ELSE 'camino' END AS type, CASE WHEN k % 5 <> 1 THEN accessible ELSE TRUE END AS accessible,
  CASE WHEN k % 7 <> 0 THEN 'P0' ELSE '' END AS levels, CASE WHEN k % 6 <> 0 THEN weight ELSE 1 END AS weight, {POINTS} FROM f"""
P13_EDGES = with_views("", "bld_edges").rstrip() + GRAPH + f""" SELECT CASE WHEN k % 4 <> 0 THEN 'rampa' ELSE '' END AS edge_type, CASE WHEN k % 5 <> 1 THEN accessible ELSE TRUE END AS acc, CASE WHEN k % 7 <> 0 THEN 'P0' ELSE '' END AS levels, {POINTS} FROM f"""
P13_NODES = with_views("""SELECT id, left(id, 1) AS tipo, CASE WHEN n % 3 <> 0 THEN 'Puerta' ELSE '' END AS nombre, CASE WHEN n % 4 <> 0 THEN 'P0' ELSE '' END AS level, CASE WHEN n % 5 <> 0 THEN n % 2 = 0 ELSE TRUE END AS acc,
  CAST(n % 64 AS DOUBLE) AS x, CAST(n % 32 AS DOUBLE) AS y, CAST(n % 8 AS DOUBLE) AS z FROM (SELECT id, CAST(substr(id, 2) AS BIGINT) AS n FROM (SELECT u AS id FROM bld_edges UNION SELECT v FROM bld_edges))""", "bld_edges")


def p10_shown_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges as consumers read them, with defaults for what is missing; a straight line for a missing path."""
    nodes, edges = route_graph(spark, sf_dir)
    at = lambda i, j: F.get(F.get("coords", F.lit(i)), F.lit(j))
    return payload.shown_edges(edges, nodes).select("u", "v", "type", "accessible", "levels", "weight", *(at(i, j).alias(f"{k}{i + 1}") for i in (0, 1) for j, k in enumerate("xyz")))


def p13_edge_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = route_graph(spark, sf_dir)
    at = lambda i, k: F.get("geometry", F.lit(i))[k]
    return export.edge_layer(edges, nodes).select("edge_type", "acc", "levels", *(at(i, k).alias(f"{k}{i + 1}") for i in (0, 1) for k in "xyz"))


def p13_node_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    layer = export.node_layer(route_graph(spark, sf_dir)[0])
    return layer.select("id", "tipo", "nombre", "level", "acc", *(c(f"geometry.{k}").alias(k) for k in "xyz"))


O1 = "SELECT concat('m', n_regionkey) AS model_id, string_agg(n_name, '|' ORDER BY n_nationkey % 3, n_nationkey) AS levels FROM nation GROUP BY n_regionkey"


def o1_storeys_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each model's storeys by height, those of one height in scan order."""
    rows = table(spark, sf_dir, "nation").select(text("m", "n_regionkey").alias("model_id"), c("n_name").alias("name"), (c("n_nationkey") % 3).cast("double").alias("elevation"), c("n_nationkey").cast("long").alias("seq"))
    return storey_list(rows).select("model_id", F.array_join("storeys.name", "|").alias("levels"))


D5 = """SELECT a, b, CAST(min(event_id) AS BIGINT) AS seq, arg_max(event_type, event_id) AS edge_type, arg_max(value, event_id) AS weight, arg_max(event_type <> 'error', event_id) AS accessible
FROM (SELECT least(concat('U', user_id), concat('T', event_id % 7)) AS a, greatest(concat('U', user_id), concat('T', event_id % 7)) AS b, * FROM events) GROUP BY a, b"""


def d5_streamed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges written once for each event, which arrive out of order, some of them twice, in several batches of a stream."""
    point = spot(F.lit(0), F.lit(0), F.lit(0))
    rows = table(spark, sf_dir, "events").select(
        F.lit(M).alias("model_id"), text("U", "user_id").alias("a"), F.concat(F.lit("T"), (c("event_id") % 7).cast("string")).alias("b"), c("event_id").alias("ord"), c("event_type").alias("edge_type"), c("value").alias("weight"),
        (c("event_type") != "error").alias("accessible"), F.array(point, point).alias("coords"),
    )
    path = f"{folder(spark)}/stream-{uuid.uuid4().hex}"
    again = F.when(F.pmod(F.xxhash64("ord"), F.lit(3)) == 0, 2).otherwise(1)
    twice = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), again)))
    twice.repartition(4, F.pmod(F.xxhash64("ord", "copy"), F.lit(4))).drop("copy").write.parquet(f"{path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{path}/in")
    upserts.arriving_edges(stream, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return upserts.current_edges(spark, f"{path}/out").select("a", "b", "seq", "edge_type", "weight", "accessible")


ORACLES = {
    "d7_storeys_by_name": D7, "d1_first_scan": D1, "d6_upserted_nodes": D6, "f20_edges_with_paths": F20, "u4_outline_fallback": U4, "j16_outline_heights": J16, "p10_shown_edges": P10,
    "p13_edge_layer": P13_EDGES, "p13_node_layer": P13_NODES, "o1_storeys_in_order": O1, "d5_streamed_edges": D5,
}
QUERIES = {f.__name__: f for f in (
    d7_storeys_by_name, d1_first_scan, d6_upserted_nodes, f20_edges_with_paths, u4_outline_fallback, j16_outline_heights, p10_shown_edges, p13_edge_layer, p13_node_layer, o1_storeys_in_order, d5_streamed_edges
)}
