"""Trees of shortest ways from few nodes of large graphs, cell by cell.

Requests on a large model mostly share an end, so a tree from that end answers them all, and no shortcuts between all border
nodes of a cell are needed. In each round every cell that got better seeds settles all that follows from them inside of it; what
got better is told to the cells next to it. So the rounds are the cells that ways pass through. The arcs of a cell are packed
once, so that a round reads arrays and touches the nodes that it reaches only.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayhall.plans.checkpoint import cut
from wayhall.plans.overlay import BEST, COUNT, FLAG, NUMBER, TEXT, _apart, _columns

KEY = ["model_id", "wheelchair", "hub"]
PACK = "model_id string, cell string, names array<string>, cells array<string>, starts binary, ends binary, weights binary, open binary"
#: Rounds after which what is known is put together, and ways get a limit.
TOGETHER = 4


def _packed(key: tuple, arcs: pa.Table) -> pa.Table:
    """A row for the cell: its nodes and then those next to it (names, of the latter their cells), and its arcs by where they start."""
    src, dst, to_cell = (arcs.column(c).combine_chunks() for c in ("src", "dst", "to_cell"))
    own = pc.unique(src)
    out = pc.not_equal(to_cell, key[1])
    beside, first = np.unique(np.asarray(pc.filter(dst, out).to_pylist(), object), return_index=True) if pc.any(out).as_py() else ([], [])
    names = own.to_pylist() + list(beside)
    at = lambda c: pc.index_in(c, value_set=pa.array(names, TEXT)).to_numpy(zero_copy_only=False).astype(np.int32)
    frm = at(src)
    order = np.argsort(frm, kind="stable")
    starts = np.concatenate([[0], np.cumsum(np.bincount(frm, minlength=len(own)))]).astype(np.int64)
    blobs = starts, at(dst)[order], arcs.column("weight").to_numpy()[order], arcs.column("accessible").to_numpy().astype(np.uint8)[order]
    cells = pc.filter(to_cell, out).take(pa.array(first, pa.int64())).to_pylist()
    row = (key[0].as_py(), key[1].as_py(), names, cells, *(b.tobytes() for b in blobs))
    many = pa.list_(TEXT)
    return _columns([row], [("model_id", TEXT), ("cell", TEXT), ("names", many), ("cells", many), *((c, pa.binary()) for c in ("starts", "ends", "weights", "open"))])


def _arcs(pack: dict, wheelchair: bool) -> tuple[list, list, list]:
    """For each node of the cell where its arcs start, and of each arc the node it leads to and the weight; for wheelchairs only of those open to them."""
    starts, ends, weights, open_ = (np.frombuffer(pack[c], kind) for c, kind in (("starts", np.int64), ("ends", np.int32), ("weights", np.float64), ("open", np.bool_)))
    if wheelchair:
        starts, ends, weights = np.concatenate([[0], np.cumsum(open_)])[starts], ends[open_], weights[open_]
    return starts.tolist(), ends.tolist(), weights.tolist()


def _search(arcs: tuple[list, list, list], names: list[str], heap: list[tuple], best: dict[int, tuple], limit: float) -> list[int]:
    """The nodes that got better by the seeds on the heap (cost, edges, before, node), which best has already; best then has their ways, by rank."""
    (starts, ends, weights), done, own = arcs, [], len(arcs[0]) - 1
    heapq.heapify(heap)
    while heap:
        cost, hops, before, at = heapq.heappop(heap)
        if best[at] != (cost, hops, before):
            continue
        done.append(at)
        if at >= own:
            continue
        name, more = names[at], hops + 1
        for k in range(starts[at], starts[at + 1]):
            to, far = ends[k], cost + weights[k]
            had = best.get(to)
            if far <= limit and (had is None or far < had[0] or (far == had[0] and (more, name) < had[1:])):
                best[to] = far, more, name
                heapq.heappush(heap, (far, more, name, to))
    return done


def _settle(key: tuple, packs: pa.Table, rows: pa.Table) -> pa.Table:
    """What gets better in a cell by the seeds among rows, and what that means for nodes next to it (told); the other rows tell what is known of its nodes."""
    model, cell = key[0].as_py(), key[1].as_py()
    known, seeds, limits, out = defaultdict(dict), defaultdict(list), {}, []
    for mode, hub, node, cost, hops, before, seed, limit in zip(*(rows.column(c).to_pylist() for c in ("wheelchair", "hub", "node", *BEST, "seed", "limit")), strict=True):
        if seed:
            seeds[mode, hub].append((cost, hops, before, node))
            limits[mode, hub] = float("inf") if limit is None else limit
        else:
            known[mode, hub][node] = min(known[mode, hub].get(node, (cost, hops, before)), (cost, hops, before))
    pack = packs.to_pylist()[0] if packs.num_rows else None
    names, cells = (pack["names"], pack["cells"]) if pack else ([], [])
    index, own = {n: i for i, n in enumerate(names)}, len(names) - len(cells)
    arcs = {mode: _arcs(pack, mode) for mode in {k[0] for k in seeds}} if pack else {}
    for (mode, hub), starts in seeds.items():
        # A hub without edges is in no pack; it is a seed once, and leads nowhere.
        out += [(model, mode, hub, cell, node, *b, False) for *b, node in starts if node not in index]
        best, heap = {index[n]: b for n, b in known[mode, hub].items() if n in index}, []
        for *b, node in sorted(starts):
            at = index.get(node)
            if at is not None and (at not in best or tuple(b) < best[at]):
                best[at] = tuple(b)
                heap.append((*b, at))
        if heap:
            out += [(model, mode, hub, cells[i - own] if i >= own else cell, names[i], *best[i], i >= own) for i in _search(arcs[mode], names, heap, best, limits[mode, hub])]
    return _columns(out, [("model_id", TEXT), ("wheelchair", FLAG), ("hub", TEXT), ("cell", TEXT), ("node", TEXT), ("cost", NUMBER), ("hops", COUNT), ("before", TEXT), ("told", FLAG)])


def trees(edges: DataFrame, node_cells: DataFrame, asked: DataFrame) -> DataFrame:
    """model_id, wheelchair, hub, node, cost, hops, before: the best ways from each hub to the nodes asked for (KEY, node), and to what they pass.

    node_cells has model_id, node, cell. Ways dearer than the dearest one asked for are dropped soon after all are found.
    """
    at = lambda c, name: node_cells.select("model_id", F.col("node").alias(c), F.col("cell").alias(name))
    flag = F.coalesce("accessible", F.lit(True)) if "accessible" in edges.columns else F.lit(True)
    ends = edges.select("model_id", "u", "v", "weight", flag.alias("accessible")).join(at("u", "cell_u"), ["model_id", "u"]).join(at("v", "cell_v"), ["model_id", "v"])
    way = lambda a, b: F.struct(F.col(a).alias("src"), F.col(b).alias("dst"), F.col(f"cell_{a}").alias("cell"), F.col(f"cell_{b}").alias("to_cell"))
    # Both ways after the joins, which so have half the rows.
    arcs = ends.select("model_id", "weight", "accessible", F.explode(F.array(way("u", "v"), way("v", "u"))).alias("e")).select("model_id", "weight", "accessible", "e.*")
    # Kept as they are dealt, so that no round moves them.
    slots = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packs = cut(arcs.groupBy("model_id", "cell").applyInArrow(_packed, PACK).repartition(slots, "model_id", "cell"))
    asked = cut(asked.select(*KEY, "node").distinct())
    best, row = F.struct(*BEST), [*KEY, "cell", "node", *BEST]
    schema = "model_id string, wheelchair boolean, hub string, cell string, node string, cost double, hops long, before string, told boolean"
    start = asked.select(*KEY, F.col("hub").alias("node")).distinct().join(at("node", "cell"), ["model_id", "node"])
    front = cut(start.select(*KEY, "cell", "node", F.lit(0.0).alias("cost"), F.lit(0).cast("long").alias("hops"), F.lit("").alias("before")))
    # What is known of a node is the best of its rows in these tables.
    parts, limits = [front.limit(0)], front.select(*KEY, F.lit(None).cast("double").alias("limit")).distinct()
    whole = lambda: reduce(DataFrame.unionByName, parts)
    once = lambda: whole().groupBy(*KEY, "cell", "node").agg(F.min(best).alias("b")).select(*KEY, "cell", "node", "b.*")
    while not front.isEmpty():
        active = F.broadcast(front.select("model_id", "cell").distinct())
        of_active = lambda df: df.join(active, ["model_id", "cell"], "left_semi")
        seeds = front.join(F.broadcast(limits), KEY).select(*row, F.lit(True).alias("seed"), "limit")
        rows = seeds.unionByName(of_active(whole()).select(*row, F.lit(False).alias("seed"), F.lit(None).cast("double").alias("limit")))
        found = cut(of_active(packs).groupBy("model_id", "cell").cogroup(_apart(rows).groupBy("model_id", "cell")).applyInArrow(_settle, schema))
        parts.append(found.where("NOT told").select(*row))
        if len(parts) > TOGETHER:
            parts[:] = [cut(once())]
            limits = asked.join(parts[0].select(*KEY, "node", "cost"), [*KEY, "node"], "left").groupBy(*KEY).agg(F.when(F.count("cost") == F.count(F.lit(1)), F.max("cost")).alias("limit"))
            limits = cut(limits)
        # One row for each node that is told of, or known: the best of both, and what is known.
        own = whole().select(*KEY, "cell", "node", F.lit(None).cast("struct<cost:double,hops:bigint,before:string>").alias("new"), best.alias("old"))
        told = found.where("told").select(*KEY, "cell", "node", best.alias("new"), F.lit(None).cast("struct<cost:double,hops:bigint,before:string>").alias("old"))
        told = told.unionByName(own).groupBy(*KEY, "cell", "node").agg(F.min("new").alias("new"), F.min("old").alias("old"))
        told = told.where("new IS NOT NULL AND (old IS NULL OR new < old)").join(F.broadcast(limits), KEY).where("limit IS NULL OR new.cost <= limit")
        front = cut(told.select(*KEY, "cell", "node", "new.*"))
    return once().drop("cell")
