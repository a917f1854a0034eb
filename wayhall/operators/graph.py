"""Assembly of nodes and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayhall.functions.text import joined_levels
from wayhall.operators.verticals import near_landings
from wayhall.plans.checkpoint import written
from wayhall.schema import LANDING, UNKNOWN_LEVEL

NODE = ["id", "name", "type", "level", "x", "y", "z", "accessible", "width", "wall_axis_x", "wall_axis_y", "wall_normal_x", "wall_normal_y"]


def upsert_nodes(rows: DataFrame) -> DataFrame:
    """One row for each (model_id, id): the last one's attributes at the first one's place (seq)."""
    kept = [c for c in rows.columns if c not in ("model_id", "id", "ord")]
    found = rows.groupBy("model_id", "id").agg(F.max_by(F.struct(*kept), "ord").alias("a"), F.min("ord").alias("seq"))
    return found.select("model_id", "id", "seq", "a.*")


def upsert_edges(rows: DataFrame) -> DataFrame:
    """One row for each unordered pair: the last one's attributes. Edges of fewer than two coordinates don't count."""
    kept = [c for c in rows.columns if c not in ("model_id", "a", "b", "ord")]
    found = rows.where(F.size("coords") >= 2).groupBy("model_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return found.agg(F.max_by(F.struct(*kept), "ord").alias("e"), F.min("ord").alias("seq")).select("model_id", "a", "b", "seq", "e.*")


def assemble_edges(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """model_id, u, v, seq, edge_type, weight, accessible, levels, coords; u is the node that was there first."""
    ends = nodes.select("model_id", "id", F.col("seq").alias("at"), F.coalesce("level", F.lit(UNKNOWN_LEVEL)).alias("level"))
    side = lambda n: ends.select("model_id", F.col("id").alias(n), F.col("at").alias(f"at_{n}"), F.col("level").alias(f"level_{n}"))
    found = upsert_edges(rows).join(side("a"), ["model_id", "a"]).join(side("b"), ["model_id", "b"])
    straight = F.col("at_a") <= F.col("at_b")
    return found.select(
        "model_id", F.when(straight, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(straight, F.col("b")).otherwise(F.col("a")).alias("v"),
        "seq", "edge_type", "weight", "accessible", joined_levels(F.col("level_a"), F.col("level_b")).alias("levels"), "coords",
    )


def assemble_landings(ends: DataFrame, by_stair: DataFrame, near: DataFrame, nodes: DataFrame) -> DataFrame:
    """assemble_edges() of near_landings(), which no other edge stands for: each flight finds its nodes before pairs are made, and no pair is moved."""
    at = nodes.select("model_id", "id", F.col("seq").alias("at"), F.coalesce("level", F.lit(UNKNOWN_LEVEL)).alias("level"))
    for end, p in (("START", "s"), ("END", "e")):
        ends = ends.drop(f"level_{p}").withColumn("id", F.concat("element_id", F.lit(f"_{end}"))).join(at.withColumnsRenamed({"at": f"at_{p}", "level": f"level_{p}"}), ["model_id", "id"]).drop("id")
    rows = near_landings(written(ends), by_stair, near, ("at_e", "level_e"), ("at_s", "level_s")).where(F.size("coords") >= 2)
    first = (F.col("at_e") < F.col("at_s")) | ((F.col("at_e") == F.col("at_s")) & (F.col("a") <= F.col("b")))
    return rows.select(
        "model_id", F.when(first, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("v"),
        F.col("ord").alias("seq"), "edge_type", "weight", "accessible", joined_levels(F.col("level_e"), F.col("level_s")).alias("levels"), "coords",
    )


def like_landings(pairs: DataFrame, u: str, v: str) -> DataFrame:
    """Those of pairs (edge_type) that aren't landings but lead from the node of a name .._END to that of another .._START, as landings do."""
    led = lambda a, b: F.col(a).endswith("_END") & F.col(b).endswith("_START") & (F.regexp_replace(a, "_END$", "") != F.regexp_replace(b, "_START$", ""))
    return pairs.where((F.col("edge_type") != LANDING) & (led(u, v) | led(v, u)))


def usable_edges(edges: DataFrame, wheelchair: bool) -> DataFrame:
    """All edges, or those open to wheelchairs (open if not told). Nodes aren't filtered."""
    return edges.where(F.coalesce("accessible", F.lit(True))) if wheelchair else edges


def joined_pairs(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """model_id, a, b, edge_type: the pairs that assemble_edges() joins, with nothing else of them. edge_type is that of a landing if all of a pair's are."""
    pairs = rows.where(F.size("coords") >= 2).groupBy("model_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max_by("edge_type", F.col("edge_type") != LANDING).alias("edge_type"))
    for end in "ab":
        pairs = pairs.join(nodes.select("model_id", F.col("id").alias(end)), ["model_id", end])
    return pairs


def summary(nodes: DataFrame, edges: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """model_id, what, n: areas, doors, flights, ramps and lifts (each once), nodes and edges.

    more (model_id, n) counts edges that aren't in the table.
    """
    own = F.when(F.col("type").isin("Escalera", "Rampa", "Ascensor"), F.regexp_replace("id", "_[^_]*$", "")).otherwise(F.col("id"))
    kind = F.when(F.col("type").isin("Habitacion", "Suelo"), "areas").otherwise(F.lower("type"))
    parts = nodes.select("model_id", kind.alias("what"), own.alias("own")).distinct().groupBy("model_id", "what").agg(F.count(F.lit(1)).alias("n"))
    total = lambda df, name: df.groupBy("model_id").agg(F.count(F.lit(1)).alias("n")).select("model_id", F.lit(name).alias("what"), "n")
    n_edges = total(edges, "edges")
    if more is not None:
        n_edges = n_edges.unionByName(more.where("n > 0").select("model_id", F.lit("edges").alias("what"), "n")).groupBy("model_id", "what").agg(F.sum("n").alias("n"))
    return parts.unionByName(total(nodes, "nodes")).unionByName(n_edges)
