"""What a user calls: build the graph of models, ask for routes, get response payloads."""

from __future__ import annotations

from dataclasses import dataclass
from types import SimpleNamespace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayhall.functions.geometry import half_even
from wayhall.operators import areas as area_ops
from wayhall.operators import base, graph, lifts, outline, verticals
from wayhall.operators import doors as door_ops
from wayhall.plans import paths
from wayhall.plans.checkpoint import cut, written
from wayhall.plans.spatial import storey_list
from wayhall.schema import DOOR, RAMP, STAIR, WALLS
from wayhall.sources.tables import Building, scan

#: What nodes come from: areas, doors, transport elements, flights, ramps; and what else is read of them.
KINDS = (("IfcSpace", "IfcSlab"), ("IfcDoor",), ("IfcTransportElement",), ("IfcStairFlight",), ("IfcRamp", "IfcRampFlight"))
NODE_CLASSES = (*(c for k in KINDS for c in k), "IfcBuildingStorey", "IfcStair")


@dataclass
class Graph:
    """Relations of one or many models: storeys, nodes, edges, outlines."""

    storeys: DataFrame
    nodes: DataFrame
    edges: DataFrame
    outlines: DataFrame

    def write(self, path: str) -> None:
        for k, df in vars(self).items():
            df.write.mode("overwrite").partitionBy("model_id").parquet(f"{path}/{k}")


def read_graph(spark: SparkSession, path: str) -> Graph:
    return Graph(**{k: spark.read.parquet(f"{path}/{k}") for k in Graph.__dataclass_fields__})


def _stages(building: Building) -> SimpleNamespace:
    """What nodes come from, and the nodes. What several stages read is computed once, in the folder of spark.checkpoint.dir."""
    # Of all elements, those that nodes come from and walls that have openings; of all vertices, theirs, dealt once.
    voids = building.rel_voids.select("model_id", F.col("wall_id").alias("element_id")).distinct()
    hosts = building.elements.where(F.col("ifc_class").isin(*WALLS)).join(voids, base.KEY)
    elements = written(scan(building.elements, *NODE_CLASSES).unionByName(hosts), "ifc_class")
    hosts = door_ops.host_walls(building.rel_fills, building.rel_voids, elements).select("model_id", F.col("wall_id").alias("element_id"))
    vertices = written(base.of_kinds(building.vertices, [*(scan(elements, *c) for c in KINDS), hosts.unionByName(scan(elements, "IfcDoor").select(*base.KEY))]))
    of = lambda k: vertices.where(F.col("kinds").bitwiseAND(F.lit(1 << k)) != 0).drop("kinds")
    placed, door_bounds, lift_bounds = (base.geometry(of(k)) for k in (0, 1, 2))
    storeys = written(base.storeys(elements, building.elements))
    levels = written(storey_list(storeys))
    areas = written(area_ops.areas(elements, written(placed), levels))
    doors = written(door_ops.doors(elements, door_bounds, levels, of(5), building.rel_fills, building.rel_voids))
    flights, ramps = (written(f(elements, of(k), levels)) for f, k in ((verticals.flight_ends, 3), (verticals.ramp_ends, 4)))
    stair_nodes, ramp_nodes = verticals.end_nodes(flights, STAIR), verticals.end_nodes(ramps, RAMP)
    lift_nodes = written(lifts.lift_nodes(lifts.lifts(elements, lift_bounds, levels, doors)))
    axes = {f"wall_{k}_{c}": F.col(f"{k}.{c}") for k in ("axis", "normal") for c in "xy"}
    plain = ["model_id", "id", "name", "type", "level", "x", "y", "z", "accessible", "ord"]
    rows = doors.withColumn("type", F.lit(DOOR)).withColumns(axes).select(*plain, "width", *axes)
    for part in (areas.withColumn("accessible", F.lit(True)), stair_nodes, ramp_nodes, lift_nodes):
        rows = rows.unionByName(part.select(*plain), allowMissingColumns=True)
    return SimpleNamespace(
        elements=elements, storeys=storeys, levels=levels, areas=areas, doors=doors, flights=flights, ramps=ramps,
        stair_nodes=stair_nodes, ramp_nodes=ramp_nodes, lift_nodes=lift_nodes, nodes=graph.upsert_nodes(rows),
    )


def build_nodes(building: Building) -> DataFrame:
    """The nodes of build_graph() alone; no edge is looked for."""
    return _stages(building).nodes


def build_ways(building: Building) -> tuple[DataFrame, DataFrame]:
    """The nodes and edges of build_graph() alone."""
    return _ways(building, _stages(building))


def build_summary(building: Building) -> DataFrame:
    """graph.summary() of the nodes and edges of build_graph(). Landings by nearness, all pairs of flights that share places, are counted, not made."""
    made = _stages(building)
    nodes = written(made.nodes)
    parts = _parts(building, made)
    pairs = written(graph.joined_pairs(parts.rows, nodes))
    if graph.like_landings(pairs, "a", "b").isEmpty():
        return graph.summary(nodes, pairs, verticals.count_near_landings(made.flights, parts.by_stair, parts.near))
    return graph.summary(nodes, graph.joined_pairs(parts.rows.unionByName(verticals.near_landings(made.flights, parts.by_stair, parts.near)), nodes))


def _parts(building: Building, made: SimpleNamespace) -> SimpleNamespace:
    """rows of all edges but landings by nearness; by_stair and near, which these come from."""
    by_stair = written(verticals.consecutive_flights(made.flights, building.rel_aggregates, made.elements))
    parts = [
        door_ops.door_edges(door_ops.door_areas(made.doors, made.areas)),
        verticals.inner_edges(made.flights, STAIR),
        verticals.end_links(made.stair_nodes, made.areas, made.doors, verticals.STAIR_REACH),
        verticals.stair_landings(by_stair),
        verticals.inner_edges(made.ramps, RAMP),
        verticals.end_links(made.ramp_nodes, made.areas, made.doors, verticals.RAMP_REACH),
        lifts.lift_edges(made.lift_nodes, made.doors, made.areas),
    ]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return SimpleNamespace(rows=rows, by_stair=by_stair, near=written(verticals.near_places(made.flights)))


def _ways(building: Building, made: SimpleNamespace) -> tuple[DataFrame, DataFrame]:
    nodes = written(made.nodes)
    parts = _parts(building, made)
    edges = written(graph.assemble_edges(parts.rows, nodes))
    if graph.like_landings(edges, "u", "v").isEmpty():
        return nodes, edges.unionByName(graph.assemble_landings(made.flights, parts.by_stair, parts.near, nodes))
    # Names of other nodes are such that an edge may be a landing too, so all are put together.
    return nodes, written(graph.assemble_edges(parts.rows.unionByName(verticals.near_landings(made.flights, parts.by_stair, parts.near)), nodes))


def build_graph(building: Building) -> Graph:
    """All stages. Nodes and edges are computed once, in the folder of spark.checkpoint.dir; landings by nearness are made from places as they are read."""
    made = _stages(building)
    nodes, edges = _ways(building, made)
    lines = outline.outlines(building.elements, building.vertices, building.rel_boundary, cut(base.geometry(building.vertices)), made.levels)
    return Graph(made.storeys, nodes, edges, lines)


def route(made: Graph, model_id: str, origin: str, destination: str, wheelchair: bool = False) -> DataFrame:
    """found, path, path_nodes, total_weight, message of one request; LookupError or ValueError for unknown ids."""
    spark = made.nodes.sparkSession
    asked = spark.createDataFrame([(model_id, 0, origin, destination, wheelchair)], "model_id string, request_id long, origin string, destination string, wheelchair boolean")
    own = made.nodes.where(F.col("model_id") == model_id)
    have = {r[0] for r in own.where(F.col("id").isin(origin, destination)).select("id").collect()}
    if not have and own.limit(1).isEmpty():
        raise LookupError(f"unknown model: {model_id}")
    for what, node in (("origin", origin), ("destination", destination)):
        if node not in have:
            raise ValueError(f"unknown {what}: {node}")
    return route_responses(paths.routes(asked, own, made.edges.where(F.col("model_id") == model_id)), own)


def route_responses(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """model_id, request_id, found, path, path_nodes, total_weight, message for each row of paths.routes()."""
    steps = found.select("model_id", "request_id", F.posexplode("path").alias("pos", "id")).join(nodes, ["model_id", "id"])
    shown = F.struct("pos", "id", "name", "type", "level", *(half_even(F.col(c), 4).alias(c) for c in "xyz"))
    listed = steps.groupBy("model_id", "request_id").agg(F.array_sort(F.collect_list(shown)).alias("steps"))
    listed = listed.withColumn("path_nodes", F.transform("steps", lambda s: F.struct(*(s[c].alias(c) for c in ("id", "name", "type", "level", "x", "y", "z"))))).drop("steps")
    ok = F.col("status") == "found"
    sign = F.when(F.col("wheelchair"), " ♿").otherwise("")
    cost = F.call_function("format_number", F.col("total_weight"), F.lit("0.0"))
    hit = F.concat(F.lit("Ruta"), sign, F.lit(" encontrada · "), F.size("path").cast("string"), F.lit(" nodos · coste "), cost)
    mode = F.when(F.col("wheelchair"), "accesible (sin escaleras)").otherwise("general")
    miss = F.concat(F.lit("No existe ruta "), mode, F.lit(" entre los nodos indicados."))
    return found.join(listed, ["model_id", "request_id"], "left").select(
        "model_id", "request_id", ok.alias("found"), "path", F.coalesce("path_nodes", F.array().cast("array<struct<id:string,name:string,type:string,level:string,x:double,y:double,z:double>>")).alias("path_nodes"),
        half_even(F.col("total_weight"), 2).alias("total_weight"), F.when(ok, hit).otherwise(miss).alias("message"),
    )
