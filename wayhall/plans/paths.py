"""Shortest paths: from a source to all nodes, the paths themselves, and batches of requests.

Of ways of equal cost the one of the fewest edges counts, then the one whose last node but one is the smallest, and so on
backwards. routes() keeps to it inside a cell of its overlay; between cells it compares the overlay's nodes alone, so where
several ways have the same cost and as many edges it may name another one than distances() does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayhall.plans.chains import steps_back
from wayhall.plans.checkpoint import cut
from wayhall.plans.overlay import CELL, Overlay, arcs_both_ways, cells, spread
from wayhall.plans.trees import trees

#: Trees that requests on one model may need, at most, to be answered by trees.
HUBS = 16

ROUTES = "model_id string, request_id long, origin string, destination string, wheelchair boolean, status string, path array<string>, total_weight double"


def distances(edges: DataFrame, sources: DataFrame, target: DataFrame | None = None) -> DataFrame:
    """model_id, node, cost, hops, before: the cheapest way to each reachable node from its model's source.

    sources has model_id and node. With target (model_id, node), ways dearer than the best one to the target are dropped;
    weights must not be negative. Rounds are the edges of the longest way; for a large model see overlay_distances().
    """
    arcs = cut(arcs_both_ways(edges).select("model_id", "src", "dst", "weight", F.lit(1).cast("long").alias("hops")))
    return spread(arcs, sources, ["model_id"], [], target)


def path_steps(found: DataFrame, targets: DataFrame | None = None, on: tuple[str, ...] = ("model_id",)) -> DataFrame:
    """on, node, pos, step: the path to each node of found, or to each of targets (on, node), from the source at pos 0.

    found has on, node and before. Paths are read back by doubling, in rounds of the logarithm of the longest.
    """
    on = list(on)
    back = cut(steps_back(found, on, targets))
    whole = back.groupBy(*on, "node").agg(F.max("back").alias("last"))
    return back.join(whole, [*on, "node"]).select(*on, "node", (F.col("last") - F.col("back")).alias("pos"), "step")


def _checked(requests: DataFrame, nodes: DataFrame) -> DataFrame:
    """Requests with the status that they have before a search: null if all they name is there."""
    known = nodes.select("model_id", "id").distinct()
    models = known.select("model_id").distinct().withColumn("has_model", F.lit(True))
    end = lambda name: known.select("model_id", F.col("id").alias(name), F.lit(True).alias(f"has_{name}"))
    asked = requests.select("model_id", F.col("request_id").cast("long").alias("request_id"), "origin", "destination", F.coalesce("wheelchair", F.lit(False)).alias("wheelchair"))
    asked = asked.join(models, "model_id", "left").join(end("origin"), ["model_id", "origin"], "left").join(end("destination"), ["model_id", "destination"], "left")
    bad = [F.when(F.col(f"has_{k}").isNull(), F.lit(f"unknown_{k}")) for k in ("model", "origin", "destination")]
    return asked.withColumn("status", F.coalesce(*bad)).drop("has_model", "has_origin", "has_destination")


ASKED = ["model_id", "wheelchair", "request_id"]


def _by_tree(valid: DataFrame, edges: DataFrame, node_cells: DataFrame) -> DataFrame:
    """ASKED, total_weight, path of requests that can be met, by a tree from the destination (back) or from the origin of each."""
    own = cut(valid.select(*ASKED, "back", F.when(F.col("back"), F.col("destination")).otherwise(F.col("origin")).alias("hub"), F.when(F.col("back"), F.col("origin")).otherwise(F.col("destination")).alias("node")))
    key = ["model_id", "wheelchair", "hub"]
    found = trees(edges, node_cells, own)
    hit = cut(own.join(found.select(*key, "node", F.col("cost").alias("total_weight")), [*key, "node"]))
    steps = path_steps(found, hit.select(*key, "node").distinct(), tuple(key))
    ways = steps.groupBy(*key, "node").agg(F.array_sort(F.collect_list(F.struct("pos", "step")))["step"].alias("way"))
    return hit.join(ways, [*key, "node"]).select(*ASKED, "total_weight", F.when(F.col("back"), F.reverse("way")).otherwise(F.col("way")).alias("path"))


def _by_overlay(valid: DataFrame, edges: DataFrame, node_cells: DataFrame) -> DataFrame:
    """ASKED, total_weight, path of requests that can be met, by searches on the overlay of cells."""
    end = lambda c: valid.select("model_id", F.col(c).alias("node"))
    made = Overlay(edges, node_cells, end("origin"), end("destination"))
    key = ASKED
    start, goal = (valid.select(*key, F.col(c).alias("node")) for c in ("origin", "destination"))
    found = made.search(start, ["request_id"], goal)
    hit = cut(found.join(goal, [*key, "node"], "left_semi").select(*key, "node", F.col("cost").alias("total_weight")))
    over = path_steps(found, hit.select(*key, "node"), tuple(key))
    # From one node of the overlay to the next: an edge between cells, or a way inside a cell.
    at = node_cells.select("model_id", F.col("node").alias("step"), "cell")
    legs = over.join(at, ["model_id", "step"])
    before = legs.select(*key, (F.col("pos") + 1).alias("pos"), F.col("step").alias("src"), F.col("cell").alias("src_cell"))
    legs = cut(legs.join(before, [*key, "pos"], "left"))
    within = legs.where("src IS NOT NULL AND src_cell = cell").select("model_id", "wheelchair", "cell", "src", F.col("step").alias("dst")).distinct()
    ways = made.inside(within).withColumnRenamed("dst", "step")
    whole = legs.join(ways, ["model_id", "wheelchair", "src", "step"], "left").withColumn("way", F.coalesce("way", F.array("step")))
    path = whole.groupBy(*key).agg(F.flatten(F.array_sort(F.collect_list(F.struct("pos", "way")))["way"]).alias("path"))
    return hit.drop("node").join(path, key).select(*ASKED, "total_weight", "path")


def routes(requests: DataFrame, nodes: DataFrame, edges: DataFrame, node_cells: DataFrame | None = None, most: int = CELL) -> DataFrame:
    """One row for each request (model_id, request_id, origin, destination, wheelchair), columns ROUTES.

    status is found, no_route, unknown_model, unknown_origin or unknown_destination. All requests on all models are searched
    at once; the wheelchair flag is part of the key. node_cells (model_id, node, cell) says how nodes are dealt; without it they
    are dealt by place, about most to a cell. Requests on a model of several cells that have few origins, or few destinations,
    are answered by a tree from each of these, where of equal ways the one counts that is the best from there; others on the
    models' overlays.
    """
    asked = cut(_checked(requests, nodes))
    valid = asked.where("status IS NULL")
    ids = valid.select("model_id").distinct()
    mine = lambda df: df.join(ids, "model_id", "left_semi")
    node_cells = cut(mine(node_cells) if node_cells is not None else cells(mine(nodes), most))
    several = node_cells.groupBy("model_id").agg(F.count_distinct("cell").alias("n")).where("n > 1")
    ends = valid.join(several, "model_id", "left_semi").groupBy("model_id").agg(F.count_distinct("origin").alias("origins"), F.count_distinct("destination").alias("destinations"))
    few = cut(ends.where(F.least("origins", "destinations") <= HUBS).select("model_id", (F.col("destinations") <= F.col("origins")).alias("back")))
    by_tree, rest = valid.join(few, "model_id"), valid.join(few, "model_id", "left_anti")
    found = [f(r, edges.join(r.select("model_id").distinct(), "model_id", "left_semi"), node_cells) for f, r in ((_by_tree, by_tree), (_by_overlay, rest)) if not r.isEmpty()]
    found = found or [valid.limit(0).select(*ASKED, F.lit(0.0).alias("total_weight"), F.array(F.lit("")).alias("path"))]
    hit = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    out = asked.join(hit, ASKED, "left")
    status = F.coalesce("status", F.when(F.col("path").isNotNull(), F.lit("found")), F.lit("no_route"))
    return out.select("model_id", "request_id", "origin", "destination", "wheelchair", status.alias("status"), F.coalesce("path", F.array().cast("array<string>")).alias("path"), "total_weight")
