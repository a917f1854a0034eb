"""What is looked for once for each place, counted without pairs, or put together without moving pairs."""

import random

from pyspark.sql import functions as F

from wayhall.operators import graph, verticals
from wayhall.operators.lifts import door_hits, lift_edges
from wayhall.operators.verticals import area_of_end, door_of_end, end_links

POINT = "struct<x:double,y:double>"


def crowd(spark, n, prefix, **more):
    rows = spark.range(n).select(F.lit("m").alias("model_id"), F.lit("a").alias("level"), F.format_string(prefix + "%05d", "id").alias("id"), F.col("id").alias("ord"), *(F.lit(v).alias(k) for k, v in more.items()))
    return rows.withColumn("normal", F.struct(F.lit(0.0).alias("x"), F.lit(1.0).alias("y")))


def test_crowds_of_ends_and_lifts(spark):
    """20,000 ends and lifts at one place, by 20,000 rooms or doors at one: 400 million pairs each."""
    n = 20_000
    rooms = crowd(spark, n, "r", x=1.0, y=1.0, min_x=0.0, min_y=0.0, min_z=0.0, max_x=2.0, max_y=2.0, max_z=3.0)
    doors = crowd(spark, n, "d", x=1.0, y=2.0)
    ends = crowd(spark, n, "e", x=1.0, y=1.5, z=0.5, probe_z=0.0).drop("normal")
    found = area_of_end(ends, rooms, 0.4)
    assert found.count() == n and [r[0] for r in found.select("area_id").distinct().collect()] == ["r00000"]
    near = door_of_end(ends, doors)
    assert near.count() == n and {tuple(r) for r in near.select("r_id", "d").distinct().collect()} == {("d00000", 0.5)}
    links = end_links(ends.unionByName(crowd(spark, n, "f", x=9.0, y=9.0, z=0.5, probe_z=0.0).drop("normal")), rooms, doors, 0.4)
    assert links.count() == n and {r[0] for r in links.select("b").distinct().collect()} == {"r00000"}
    stops = ends.withColumnRenamed("id", "element_id").withColumn("id", F.concat("element_id", F.lit("_a"))).withColumn("pos", F.lit(0))
    by_door = lift_edges(stops, doors, rooms)
    assert by_door.count() == 2 * n and {tuple(sorted(r)) for r in by_door.groupBy("a").agg(F.collect_set("b").alias("b")).select("b").distinct().collect()[0]} == {("d00000", "d00001")}
    by_area = lift_edges(stops, doors.where("id < 'd'"), rooms)
    assert by_area.count() == n and {r[0] for r in by_area.select("b").distinct().collect()} == {"r00000"}
    touched = F.array(F.struct(F.lit("a").alias("name")), F.struct(F.lit("b").alias("name")))
    cabins = stops.select("model_id", "element_id", F.col("x").alias("cx"), F.col("y").alias("cy"), touched.alias("touched"))
    assert {tuple(r) for r in door_hits(cabins, doors).groupBy("hits").count().collect()} == {(1, n)}


def flights(spark, n, seed):
    rnd = random.Random(seed)
    spot = lambda: [float(rnd.randrange(4)) for _ in "xy"] + [float(rnd.randrange(2))]
    rows = [("m" if i % 3 else "k", f"F{i}", i, *spot(), *spot(), "a", "b", 0.0, 0.0) for i in range(n)]
    return spark.createDataFrame(rows, "model_id string, element_id string, seq long, sx double, sy double, sz double, ex double, ey double, ez double, level_s string, level_e string, elev_s double, elev_e double")


def test_landings_without_moving_pairs(spark):
    """As many, and the same, as all rows put together; those by stair count once."""
    made = flights(spark, 60, 4)
    near = verticals.near_places(made)
    stairs = spark.createDataFrame([("m", "P", f"F{i}", i, i) for i in range(1, 30) if i % 3] + [("k", "P", "F0", 0, 0), ("k", "P", "F3", 3, 0)], "model_id string, parent_id string, child_id string, seq long, child_pos int")
    by_stair = verticals.consecutive_flights(made, stairs, spark.createDataFrame([("m", "P", "IfcStair"), ("k", "P", "IfcStair")], "model_id string, element_id string, ifc_class string"))
    nodes = graph.upsert_nodes(verticals.end_nodes(made, "Escalera").drop("element_id", "seq", "probe_z"))
    want = graph.assemble_edges(verticals.landing_edges(made, stairs, spark.createDataFrame([("m", "P", "IfcStair"), ("k", "P", "IfcStair")], "model_id string, element_id string, ifc_class string")), nodes)
    rest = graph.assemble_edges(verticals.stair_landings(by_stair), nodes)
    pairs = graph.assemble_landings(made, by_stair, near, nodes)
    text = lambda df: sorted(map(str, df.select(*want.columns).collect()))
    assert text(rest.unionByName(pairs)) == text(want)
    ends = {(r["model_id"], r["element_id"]): r for r in made.collect()}
    close = {(f[0], f[1], t[1]) for f, a in ends.items() for t, b in ends.items() if f[0] == t[0] and f != t and (a["ex"] - b["sx"]) ** 2 + (a["ey"] - b["sy"]) ** 2 <= 2.25 and abs(a["ez"] - b["sz"]) <= 0.5}
    stair = {tuple(r) for r in by_stair.select("model_id", "from_id", "to_id").collect()}
    counted = {r["model_id"]: r["n"] for r in verticals.count_near_landings(made, by_stair, near).collect()}
    assert close & stair and stair - close and counted == {m: sum(p[0] == m for p in close - stair) for m in "mk"}


def test_edges_that_look_like_landings(spark):
    rows = [("F1_END", "F2_START", "puerta_espacio"), ("F3_START", "F1_END", "rampa"), ("F1_END", "F2_START", "escalera_rellano"), ("F1_START", "F1_END", "escalera"), ("D1", "F1_END", "vertical_puerta")]
    pairs = spark.createDataFrame(rows, "u string, v string, edge_type string")
    assert {r["edge_type"] for r in graph.like_landings(pairs, "u", "v").collect()} == {"puerta_espacio", "rampa"}


def test_summary_counts_landings(spark):
    from tests.micro import building
    from wayhall.api import build_summary, build_ways

    made = building(spark)
    assert sorted(map(tuple, build_summary(made).collect())) == sorted(map(tuple, graph.summary(*build_ways(made)).collect()))
