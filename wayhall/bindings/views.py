"""A building derived from the driver tables, in SQL that Spark and DuckDB both run.

Coordinates are integers over powers of two, so both engines agree on every comparison.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayhall import schema
from wayhall.plans.checkpoint import dealt
from wayhall.sources.tables import Building, empty_building

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
VIEWS = {
    "bld_storeys": "SELECT r_name AS name, CAST(r_regionkey * 4 AS DOUBLE) AS elevation, CAST(r_regionkey AS BIGINT) AS seq FROM region",
    "bld_spaces": """SELECT CONCAT('S', CAST(p_partkey AS VARCHAR(20))) AS id, p_partkey AS seq, p_partkey % 5 AS lv,
  CAST(p_partkey * 37 % 1024 AS DOUBLE) / 4 AS min_x, CAST(p_partkey * 91 % 1024 AS DOUBLE) / 4 AS min_y,
  CAST(p_partkey * 37 % 1024 AS DOUBLE) / 4 + 1 + CAST(p_size % 16 AS DOUBLE) / 4 AS max_x,
  CAST(p_partkey * 91 % 1024 AS DOUBLE) / 4 + 1 + CAST(p_partkey % 13 AS DOUBLE) / 4 AS max_y,
  CAST(p_partkey % 5 * 4 AS DOUBLE) + CAST(p_partkey % 3 AS DOUBLE) / 8 AS min_z,
  CAST(p_partkey % 5 * 4 AS DOUBLE) + CAST(p_partkey % 3 AS DOUBLE) / 8 + 3 AS max_z FROM part""",
    "bld_doors": """SELECT CONCAT('D', CAST(c_custkey AS VARCHAR(20))) AS id, c_custkey AS seq, c_custkey % 5 AS lv,
  CAST(c_custkey * 53 % 4096 AS DOUBLE) / 16 AS x, CAST(c_custkey * 29 % 4096 AS DOUBLE) / 16 AS y,
  CAST(c_custkey % 5 * 4 AS DOUBLE) + CAST(c_custkey % 3 AS DOUBLE) / 8 AS z, CAST(c_custkey % 7 AS DOUBLE) / 4 AS width FROM customer""",
    "bld_vertices": """SELECT l_orderkey AS element_id,
  ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS vseq,
  l_quantity AS x, CAST(l_partkey % 64 AS DOUBLE) / 2 AS y, CAST(l_linenumber % 4 AS DOUBLE) / 8 AS z FROM lineitem""",
    "bld_flights": """SELECT s_suppkey AS flight_id, s_nationkey AS parent_id,
  CAST(s_suppkey * 17 % 64 AS DOUBLE) / 8 AS sx, CAST(s_suppkey * 43 % 61 AS DOUBLE) / 8 AS sy, CAST(s_suppkey % 5 * 4 AS DOUBLE) AS sz,
  CAST(s_suppkey * 17 % 64 AS DOUBLE) / 8 + 1 AS ex, CAST(s_suppkey * 43 % 61 AS DOUBLE) / 8 + 1 AS ey,
  CAST(s_suppkey % 5 * 4 AS DOUBLE) + 4 - CAST(s_suppkey % 4 AS DOUBLE) / 4 AS ez FROM supplier""",
    "bld_transport": """SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'ELEVATOR' WHEN 'F' THEN 'ESCALATOR' ELSE NULL END AS predefined_type,
  o_orderpriority AS name, CAST(o_orderkey * 9973 % 32768 AS DOUBLE) / 16 AS x, CAST(o_orderkey * 21023 % 32768 AS DOUBLE) / 16 AS y,
  CAST(o_orderkey % 11 AS DOUBLE) / 2 + CAST(0.5 AS DOUBLE) AS dx, CAST(o_orderkey % 9 AS DOUBLE) / 2 + CAST(0.5 AS DOUBLE) AS dy,
  CAST((o_orderkey % 250 - o_orderkey % 50) * 4 / 50 AS DOUBLE) AS min_z FROM orders""",
    "bld_edges": """SELECT CONCAT('C', CAST(c_custkey AS VARCHAR(20))) AS u, CONCAT('N', CAST(c_nationkey AS VARCHAR(20))) AS v,
    CASE WHEN c_custkey % 5 = 0 THEN CAST(999999 AS DOUBLE) ELSE 1 + CAST(c_custkey % 8 AS DOUBLE) / 8 END AS weight, c_custkey % 5 <> 0 AS accessible FROM customer
  UNION ALL SELECT CONCAT('N', CAST(n_nationkey AS VARCHAR(20))), CONCAT('R', CAST(n_regionkey AS VARCHAR(20))), CAST(1 AS DOUBLE), n_nationkey % 6 <> 0 FROM nation
  UNION ALL SELECT CONCAT('R', CAST(r_regionkey AS VARCHAR(20))), CONCAT('R', CAST((r_regionkey + 1) % 5 AS VARCHAR(20))), CAST(1 AS DOUBLE), TRUE FROM region""",
}
M = "m"
#: Height of the derived transport elements, in whole storeys and a bit by their number.
TRANSPORT_HEIGHT = "CASE WHEN id % 3 = 0 THEN 8.0 ELSE 2.5 END"


def with_views(sql: str, *names: str) -> str:
    """sql for DuckDB, with the named views before it."""
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in names) + " " + sql


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view, with model_id. Line items are dealt by order, so that those of a task don't grow with the table."""
    for t in BASE:
        if f" {t}" in VIEWS[name]:
            rows = spark.read.parquet(f"{sf_dir}/{t}.parquet")
            (dealt(rows, "l_orderkey") if t == "lineitem" else rows).createOrReplaceTempView(t)
    return spark.sql(VIEWS[name]).withColumn("model_id", F.lit(M))


def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "bld_vertices").select("model_id", F.concat(F.lit("V"), F.col("element_id").cast("string")).alias("element_id"), F.col("vseq").cast("int").alias("vseq"), "x", "y", "z")


def _element(df: DataFrame, ident, kind, seq, **more) -> DataFrame:  # noqa: ANN001
    names = [c.split()[0] for c in schema.ELEMENTS.split(", ")]
    kinds = dict(c.split() for c in schema.ELEMENTS.split(", "))
    own = {"model_id": F.lit(M), "element_id": ident, "ifc_class": kind if not isinstance(kind, str) else F.lit(kind), "seq": seq} | more
    return df.select(*(own.get(n, F.lit(None)).cast(kinds[n]).alias(n) for n in names))


def _corners(df: DataFrame, ident, low: list, high: list) -> DataFrame:  # noqa: ANN001
    spot = lambda p: F.struct(*(c.cast("double").alias(n) for c, n in zip(p, "xyz", strict=True)))
    rows = df.select(F.lit(M).alias("model_id"), ident.alias("element_id"), F.posexplode(F.array(spot(low), spot(high))).alias("vseq", "p"))
    return rows.select("model_id", "element_id", "vseq", "p.*")


def building(spark: SparkSession, sf_dir: str) -> Building:
    """The whole derived building: storeys, rooms, slabs, doors, flights in stairs, ramps, transport elements, walls."""
    v = {n: view(spark, sf_dir, n) for n in VIEWS}
    c = F.col
    name = lambda prefix, col: F.concat(F.lit(prefix), c(col).cast("string"))
    rooms = v["bld_spaces"].where("seq % 3 <> 0")
    slabs = v["bld_spaces"].where("seq % 3 = 0")
    meshes = v["bld_vertices"].select("element_id").distinct()
    wall = F.when(c("element_id") % 8 < 3, "IfcWall").when(c("element_id") % 8 < 6, "IfcWallStandardCase").otherwise("IfcRamp")
    flight = v["bld_flights"]
    transport = v["bld_transport"].withColumn("dz", F.expr(TRANSPORT_HEIGHT))
    parts = [
        _element(v["bld_storeys"], name("L", "seq"), "IfcBuildingStorey", c("seq"), name=c("name"), elevation=c("elevation").cast("string")),
        _element(rooms, c("id"), "IfcSpace", c("seq")),
        _element(slabs, c("id"), "IfcSlab", c("seq"), predefined_type=F.when(c("seq") % 12 == 0, "ROOF")),
        _element(v["bld_doors"], c("id"), "IfcDoor", c("seq"), overall_width=c("width")),
        _element(flight, name("F", "flight_id"), "IfcStairFlight", c("flight_id")),
        _element(flight.select("parent_id").distinct(), name("P", "parent_id"), "IfcStair", c("parent_id")),
        _element(transport, name("T", "id"), "IfcTransportElement", c("id"), name=c("name"), predefined_type=c("predefined_type")),
        _element(meshes, name("V", "element_id"), wall, c("element_id"), is_external=c("element_id") % 4 == 0),
    ]
    elements = parts[0]
    for p in parts[1:]:
        elements = elements.unionByName(p)
    points = vertices(spark, sf_dir)
    for df, ident, low, high in (
        (v["bld_spaces"], c("id"), [c("min_x"), c("min_y"), c("min_z")], [c("max_x"), c("max_y"), c("max_z")]),
        (v["bld_doors"], c("id"), [c("x"), c("y"), c("z")], [c("x"), c("y"), c("z") + 2]),
        (flight, name("F", "flight_id"), [c("sx"), c("sy"), c("sz")], [c("ex"), c("ey"), c("ez")]),
        (transport, name("T", "id"), [c("x"), c("y"), c("min_z")], [c("x") + c("dx"), c("y") + c("dy"), c("min_z") + c("dz")]),
    ):
        points = points.unionByName(_corners(df, ident, low, high))
    rest = empty_building(spark)
    ids = v["bld_doors"].where("seq % 2 = 0")
    opening = name("O", "seq")
    host = F.concat(F.lit("V"), (c("seq") % 1000 + 1).cast("string"))
    return Building(
        elements, points,
        ids.select("model_id", "seq", c("id").alias("element_id"), opening.alias("opening_id")),
        ids.select("model_id", "seq", opening.alias("opening_id"), host.alias("wall_id")),
        rest.rel_boundary.unionByName(meshes.where("element_id % 7 = 0").select(F.lit(M).alias("model_id"), c("element_id").alias("seq"), name("V", "element_id").alias("element_id"))),
        flight.select("model_id", c("flight_id").alias("seq"), name("P", "parent_id").alias("parent_id"), name("F", "flight_id").alias("child_id"), F.lit(0).alias("child_pos")),
    )
