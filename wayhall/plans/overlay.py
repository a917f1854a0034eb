"""Shortest paths in graphs of any size, by a two-level overlay.

A model's nodes are dealt to cells of a bounded number. Inside a cell all shortest ways between its border nodes, those
with an edge to another cell, are found at once, every cell by itself. These shortcuts and the edges between cells make the
overlay, on which a search takes as many rounds as a way crosses cells, not nodes. What lies inside the cells of a result
is filled in afterwards, again cell by cell. No group holds more than a cell.

Ways are ranked by cost, then by the number of edges, then by the smallest node before.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayhall.plans.checkpoint import cut

#: Nodes of a cell at most, and depth of the tree of tiles that cells come from.
CELL, DEPTH = 16384, 12
BEST = ("cost", "hops", "before")


def _morton(x: Column, y: Column) -> Column:
    """The bits of two whole numbers below 2**DEPTH, one of y after one of x."""
    bit = lambda v, i: F.shiftright(v, i).bitwiseAND(F.lit(1))
    out = F.lit(0).cast("long")
    for i in range(DEPTH):
        out = out.bitwiseOR(F.shiftleft(bit(x, i), 2 * i + 1)).bitwiseOR(F.shiftleft(bit(y, i), 2 * i))
    return out


def cells(nodes: DataFrame, most: int = CELL) -> DataFrame:
    """model_id, node, cell: nodes (model_id, id, level, x, y) in cells of about most at most.

    A model that is small enough is a cell, else a level, else the largest quarter of a quarter.. of a level that is.
    Where too many stand in one spot they are dealt by hash. Coordinates that are missing or not finite count as 0, missing levels as a level.
    """
    for c, kind in (("level", "string"), ("x", "double"), ("y", "double")):
        nodes = nodes if c in nodes.columns else nodes.withColumn(c, F.lit(None).cast(kind))
    place = nodes.select("model_id", F.col("id").alias("node"), F.coalesce("level", F.lit("")).alias("level"), *(F.when(F.abs(c) < 1e15, F.col(c)).otherwise(0.0).alias(c) for c in "xy"))
    place = place.join(place.groupBy("model_id").agg(F.count(F.lit(1)).alias("total")), "model_id")
    whole = place.where(F.col("total") <= most).select("model_id", "node", F.lit("").alias("cell"))
    place = place.where(F.col("total") > most).drop("total")
    return whole if place.isEmpty() else whole.unionByName(_tiles(place, most))


def _tiles(place: DataFrame, most: int) -> DataFrame:
    """cells() of models of more than most nodes: model_id, node, level, x, y."""
    spans = place.groupBy("model_id", "level").agg(*(f(c).alias(f"{n}_{c}") for c in "xy" for n, f in (("min", F.min), ("max", F.max))))
    unit = lambda c: F.least(F.floor((F.col(c) - F.col(f"min_{c}")) / F.greatest(F.col(f"max_{c}") - F.col(f"min_{c}"), F.lit(1e-9)) * (1 << DEPTH)), F.lit((1 << DEPTH) - 1)).cast("long")
    spots = place.join(spans, ["model_id", "level"]).select("model_id", "node", "level", _morton(unit("x"), unit("y")).alias("code"))
    fine = cut(spots.groupBy("model_id", "level", "code").agg(F.count(F.lit(1)).alias("n")))
    # Depth 1 is the level, each further one a quarter of what is above. The tiles above a spot that hold too many are the first of them, so their number tells its own.
    tile = F.expr(f"shiftright(code, cast(2 * ({DEPTH} + 1 - depth) as int))")
    above = fine.withColumn("depth", F.explode(F.sequence(F.lit(1), F.lit(DEPTH + 1)))).withColumn("tile", tile)
    full = above.groupBy("model_id", "level", "depth", "tile").agg(F.sum("n").alias("total")).where(F.col("total") > most).drop("total")
    deep = above.join(F.broadcast(full), ["model_id", "level", "depth", "tile"]).groupBy("model_id", "level", "code").agg(F.count(F.lit(1)).alias("full"))
    dealt = fine.join(deep, ["model_id", "level", "code"], "left").withColumn("depth", F.coalesce("full", F.lit(0)) + 1).withColumn("slots", F.ceil(F.col("n") / most))
    named = F.when(F.col("depth") == 1, F.col("level")).when(F.col("depth") <= DEPTH + 1, F.concat_ws("/", "level", F.col("depth").cast("string"), tile.cast("string")))
    crowd = F.concat_ws("/", "level", F.lit("*"), F.col("code").cast("string"), F.pmod(F.xxhash64("node"), F.col("slots")).cast("string"))
    return spots.join(dealt.drop("n", "full"), ["model_id", "level", "code"]).select("model_id", "node", F.coalesce(named, crowd).alias("cell"))


def search(arcs: dict[str, list[tuple[str, float]]], seeds: Iterable[tuple[float, int, str, str]], through: set[str] | None = None) -> dict[str, tuple[float, int, str]]:
    """Cost, edges and node before of all that the seeds (cost, edges, before, node) reach, by rank; not beyond nodes of through."""
    heap, done = list(seeds), {}
    origins = {s[3] for s in heap}
    heapq.heapify(heap)
    while heap:
        cost, hops, before, at = heapq.heappop(heap)
        if at in done:
            continue
        done[at] = cost, hops, before
        if through is not None and at in through and at not in origins:
            continue
        for to, w in arcs.get(at, ()):
            if to not in done:
                heapq.heappush(heap, (cost + w, hops + 1, at, to))
    return done


def _arcs(table: pa.Table) -> tuple[dict, dict]:
    """Arcs of all edges, and of those that are open to wheelchairs."""
    free, open_ = defaultdict(list), defaultdict(list)
    for r in table.to_pylist():
        free[r["src"]].append((r["dst"], r["weight"]))
        if r["accessible"]:
            open_[r["src"]].append((r["dst"], r["weight"]))
    return free, open_


def _columns(rows: list[tuple], kinds: list[tuple[str, pa.DataType]]) -> pa.Table:
    return pa.table({name: pa.array([r[i] for r in rows], kind) for i, (name, kind) in enumerate(kinds)})


def _apart(df: DataFrame) -> DataFrame:
    """df with columns of their own, to be grouped beside one that it came from."""
    return df.select(*(F.col(c).alias(c) for c in df.columns))


TEXT, NUMBER, COUNT, FLAG = pa.string(), pa.float64(), pa.int64(), pa.bool_()


def arcs_both_ways(edges: DataFrame) -> DataFrame:
    """model_id, src, dst, weight, accessible: each undirected edge in both directions; open to wheelchairs if not told."""
    ends = F.array(F.struct(F.col("u").alias("src"), F.col("v").alias("dst")), F.struct(F.col("v").alias("src"), F.col("u").alias("dst")))
    flag = F.coalesce("accessible", F.lit(True)) if "accessible" in edges.columns else F.lit(True)
    return edges.select("model_id", F.explode(ends).alias("e"), "weight", flag.alias("accessible")).select("model_id", "e.*", "weight", "accessible")


def spread(arcs: DataFrame, sources: DataFrame, on: list[str], own: list[str], target: DataFrame | None = None) -> DataFrame:
    """on, own, node, cost, hops, before: the best way to each node that the sources (on, own, node) reach.

    arcs has on, src, dst, weight and hops (edges that it stands for); own are more columns of the sources, such as the
    request. Each round relaxes the arcs of all nodes that got better in the round before. With target (on, own, node),
    ways dearer than the best one to the target are dropped. Weights must not be negative.
    """
    key, best = [*on, *own], F.struct(*BEST)
    known = cut(sources.select(*key, "node", F.lit(0.0).alias("cost"), F.lit(0).cast("long").alias("hops"), F.lit("").alias("before")).distinct())
    front = known
    while not front.isEmpty():
        reached = front.withColumnRenamed("node", "src").withColumnRenamed("hops", "edges").join(arcs, [*on, "src"]).select(
            *key, F.col("dst").alias("node"), (F.col("cost") + F.col("weight")).alias("cost"), (F.col("edges") + F.col("hops")).alias("hops"), F.col("src").alias("before")
        )
        reached = reached.groupBy(*key, "node").agg(F.min(best).alias("new")).join(known.select(*key, "node", best.alias("old")), [*key, "node"], "left")
        reached = reached.where(F.col("old").isNull() | (F.col("new") < F.col("old")))
        if target is not None:
            limit = known.join(target, [*key, "node"], "left_semi").select(*key, F.col("cost").alias("limit"))
            reached = reached.join(limit, key, "left").where(F.col("limit").isNull() | (F.col("new.cost") <= F.col("limit"))).drop("limit")
        front = cut(reached.select(*key, "node", "new.*"))
        known = cut(known.unionByName(front).groupBy(*key, "node").agg(F.min(best).alias("b")).select(*key, "node", "b.*"))
    return known


class Overlay:
    """Cells, shortcuts and edges between cells of a table of graphs, for searches from origins to ends.

    origins and ends (model_id, node) are nodes that searches start from and may end at; a way may pass through either
    inside a cell. Shortcuts lead from origins and border nodes to ends and border nodes of their cell.
    """

    def __init__(self, edges: DataFrame, node_cells: DataFrame, origins: DataFrame, ends: DataFrame, modes: tuple[bool, ...] = (False, True)):
        arcs = arcs_both_ways(edges)
        at = lambda c, name: node_cells.select("model_id", F.col("node").alias(c), F.col("cell").alias(name))
        told = cut(arcs.join(at("src", "cell"), ["model_id", "src"]).join(at("dst", "to_cell"), ["model_id", "dst"]))
        self.modes = modes
        self.inner = told.where("cell = to_cell").drop("to_cell")
        self.between = told.where("cell <> to_cell")
        border = self.between.select("model_id", F.col("src").alias("node"), "cell").distinct()
        role = lambda df, name: df.select("model_id", "node").distinct().join(node_cells, ["model_id", "node"]).select("model_id", "node", "cell", F.lit(name).alias("role"))
        roles = border.select("model_id", "node", "cell", F.lit("border").alias("role")).unionByName(role(origins, "origin")).unionByName(role(ends, "end"))
        self.arcs = cut(self._shortcuts(roles).unionByName(self._crossings()))

    def _crossings(self) -> DataFrame:
        mode = F.explode(F.array(*(F.lit(m) for m in self.modes)))
        both = self.between.select("model_id", mode.alias("wheelchair"), "src", "dst", "weight", F.lit(1).cast("long").alias("hops"), "accessible")
        return both.where("accessible OR NOT wheelchair").drop("accessible")

    def _shortcuts(self, roles: DataFrame) -> DataFrame:
        modes = self.modes
        kinds = [("model_id", TEXT), ("wheelchair", FLAG), ("src", TEXT), ("dst", TEXT), ("weight", NUMBER), ("hops", COUNT)]

        def run(key: tuple, inner: pa.Table, told: pa.Table) -> pa.Table:
            by_role = defaultdict(set)
            for r in told.to_pylist():
                by_role[r["role"]].add(r["node"])
            border, arcs, out = by_role["border"], _arcs(inner), []
            ends = border | by_role["end"]
            for mode in modes if inner.num_rows else ():
                for a in sorted(border | by_role["origin"]):
                    found = search(arcs[mode], [(0.0, 0, "", a)], border)
                    out += [(key[0].as_py(), mode, a, b, *found[b][:2]) for b in sorted(ends & found.keys()) if a != b]
            return _columns(out, kinds)

        own = self.inner.select("model_id", "cell", "src", "dst", "weight", "accessible").groupBy("model_id", "cell")
        return own.cogroup(_apart(roles).groupBy("model_id", "cell")).applyInArrow(run, "model_id string, wheelchair boolean, src string, dst string, weight double, hops long")

    def search(self, sources: DataFrame, own: list[str], target: DataFrame | None = None) -> DataFrame:
        """spread() over the overlay; sources and target have model_id, wheelchair, own and node."""
        return spread(self.arcs, sources, ["model_id", "wheelchair"], own, target)

    def inside(self, pairs: DataFrame) -> DataFrame:
        """model_id, wheelchair, src, dst, way: the nodes after src up to dst, for distinct pairs (.., cell, src, dst) of one cell."""
        kinds = [("model_id", TEXT), ("wheelchair", FLAG), ("src", TEXT), ("dst", TEXT), ("way", pa.list_(TEXT))]

        def run(key: tuple, inner: pa.Table, asked: pa.Table) -> pa.Table:
            arcs, out, known = _arcs(inner), [], {}
            for r in sorted(asked.to_pylist(), key=lambda r: (r["wheelchair"], r["src"])):
                start = (r["wheelchair"], r["src"])
                if start not in known:
                    known = {start: search(arcs[r["wheelchair"]], [(0.0, 0, "", r["src"])])}
                way, at = [], r["dst"]
                while at != r["src"]:
                    way.append(at)
                    at = known[start][at][2]
                out.append((key[0].as_py(), r["wheelchair"], r["src"], r["dst"], way[::-1]))
            return _columns(out, kinds)

        own = self.inner.select("model_id", "cell", "src", "dst", "weight", "accessible").groupBy("model_id", "cell")
        return own.cogroup(_apart(pairs).groupBy("model_id", "cell")).applyInArrow(run, "model_id string, wheelchair boolean, src string, dst string, way array<string>")

    def filled(self, found: DataFrame, node_cells: DataFrame, own: list[str]) -> DataFrame:
        """model_id, wheelchair, own, node, cost, hops, before of all nodes, from what search() found without a target."""
        at = lambda c, name: node_cells.select("model_id", F.col("node").alias(c), F.col("cell").alias(name))
        seeds = found.join(at("node", "cell"), ["model_id", "node"]).join(at("before", "from_cell"), ["model_id", "before"], "left")
        # Those that a shortcut led to are found again from inside their cell, with the node that really stands before them.
        seeds = seeds.where("from_cell IS NULL OR from_cell <> cell").drop("from_cell")
        key = ["model_id", "wheelchair", *own]
        kinds = {c: found.schema[c].dataType.simpleString() for c in key}

        def run(cell: tuple, inner: pa.Table, starts: pa.Table) -> pa.Table:
            arcs, by_key = _arcs(inner), defaultdict(list)
            for r in starts.to_pylist():
                by_key[tuple(r[c] for c in key)].append((r["cost"], r["hops"], r["before"], r["node"]))
            out = [(*k, n, *b) for k, s in by_key.items() for n, b in search(arcs[k[1]], s).items()]
            return _columns(out, [*((c, starts.schema.field(c).type) for c in key), ("node", TEXT), ("cost", NUMBER), ("hops", COUNT), ("before", TEXT)])

        schema = ", ".join([*(f"{c} {kinds[c]}" for c in key), "node string, cost double, hops long, before string"])
        inner = self.inner.select("model_id", "cell", "src", "dst", "weight", "accessible").groupBy("model_id", "cell")
        return inner.cogroup(_apart(seeds.select(*key, "cell", "node", *BEST)).groupBy("model_id", "cell")).applyInArrow(run, schema)


def overlay_distances(edges: DataFrame, sources: DataFrame, node_cells: DataFrame) -> DataFrame:
    """model_id, node, cost, hops, before, as distances() gives them: from each model's source (model_id, node) to all it reaches.

    node_cells has model_id, node, cell; see cells(). Costs are sums in another order, so they agree up to rounding.
    """
    made = Overlay(edges, node_cells, sources, sources.limit(0), (False,))
    starts = sources.select("model_id", F.lit(False).alias("wheelchair"), "node")
    return made.filled(made.search(starts, []), node_cells, []).drop("wheelchair")
