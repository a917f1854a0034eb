"""Greedy passes in scan order, over parts of the items at once.

A pass that accepts an item unless an earlier accepted item stands against it has one result, whichever way it is
computed: an item is accepted once all earlier items against it are refused, and refused once one of them is accepted.
Items are dealt to cells, of neighbours where the caller knows places. In each round every cell settles, by itself, all that
follows from what is known of items outside of it; what is settled is told to the cells that wait for it. So the rounds are
the most cells that a chain of items which stand against each other passes through, not the items of the chain.

refused() and leaders() take the pairs that stand against each other. Where these come from places, settled() takes the
places and makes no pairs: they would grow with the square of the items of a place.
"""

from __future__ import annotations

import math
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayhall.plans.checkpoint import cut
from wayhall.plans.overlay import cells

#: Items of a cell, and conflicts where cells are dealt by hash, at most.
ITEMS, CONFLICTS = 1 << 16, 1 << 18
#: Columns of the box of an item: where it stands against others that come later.
BOX = [f"{m}_{c}" for m in ("min", "max") for c in "xyz"]


def _settled(waiting: DataFrame) -> DataFrame:
    """item, kept: what follows in each cell. waiting has cell, earlier, later and known, whether earlier is kept if that is known."""
    kind = waiting.schema["later"].dataType.simpleString()

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        name = {}
        number = lambda text: name.setdefault(text, len(name))
        earlier, later = ([number(t) for t in rows.column(c).to_pylist()] for c in ("earlier_key", "later_key"))
        against, open_, at, state = defaultdict(list), defaultdict(int), {}, {}
        for i, (a, b, known) in enumerate(zip(earlier, later, rows.column("known").to_pylist(), strict=True)):
            at[b] = i
            if known is None:
                against[a].append(b)
                open_[b] += 1
            elif known:
                state[b] = False
        queue = list(state) + [b for b in at if b not in state and not open_[b]]
        for b in queue:
            state.setdefault(b, True)
        while queue:
            a = queue.pop()
            for b in against[a]:
                if b in state:
                    continue
                open_[b] -= 1
                if state[a] or not open_[b]:
                    state[b] = not state[a]
                    queue.append(b)
        found = list(state)
        items = rows.column("later").combine_chunks().take(pa.array([at[b] for b in found], pa.int64()))
        if pa.types.is_struct(items.type):  # fields may say that they are never null, which the result's don't
            items = items.cast(pa.struct([f.with_nullable(True) for f in items.type]))
        return pa.table({"item": items, "kept": pa.array([state[b] for b in found], pa.bool_())})

    told = waiting.select("cell", "earlier", "later", "known", *(F.to_json(F.struct(F.col(c).alias("key"))).alias(f"{c}_key") for c in ("earlier", "later")))
    return told.drop("earlier").groupBy("cell").applyInArrow(run, f"item {kind}, kept boolean")


def refused(conflicts: DataFrame, item_cells: DataFrame | None = None) -> DataFrame:
    """item: those refused. conflicts has rows (earlier, later): earlier stands against later if it is accepted.

    item_cells (item, cell) says how items are dealt; without it they are dealt by hash, all to one cell if conflicts are few.
    """
    edges = cut(conflicts.select("earlier", "later").distinct())
    if item_cells is None:
        slots = edges.count() // CONFLICTS + 1
        edges = edges.withColumn("cell", F.pmod(F.xxhash64("later"), F.lit(slots)).cast("string"))
    else:
        edges = edges.join(item_cells.select(F.col("item").alias("later"), "cell"), "later")
    later = edges.select(F.col("later").alias("earlier"), F.lit(True).alias("told")).distinct()
    waiting = edges.join(later, "earlier", "left").select("cell", "earlier", "later", F.when(F.col("told").isNull(), F.lit(True)).alias("known"))
    waiting, out = cut(waiting), None
    while not waiting.isEmpty():
        settled = cut(_settled(waiting))
        gone = settled.where("NOT kept").select("item")
        out = gone if out is None else out.unionByName(gone)
        left = waiting.join(settled.select(F.col("item").alias("later")), "later", "left_anti")
        told = left.join(settled.select(F.col("item").alias("earlier"), "kept"), "earlier", "left")
        waiting = cut(told.select("cell", "earlier", "later", F.coalesce("known", "kept").alias("known")))
    return out if out is not None else edges.select(F.col("earlier").alias("item"))


def leaders(items: DataFrame, near: DataFrame, item_cells: DataFrame | None = None) -> DataFrame:
    """item, leader: each item's cluster when, in order, an item joins the first cluster whose leader is near it.

    items has item and order; near has rows (earlier, later) of items near each other, earlier before later. item_cells
    as for refused().
    """
    near = cut(near.select("earlier", "later").distinct())
    not_leading = refused(near, item_cells)
    own = items.join(not_leading, "item", "left_anti").select("item", "order")
    first = (
        near.join(not_leading, near.later == not_leading.item, "left_semi")
        .join(own.select(F.col("item").alias("earlier"), "order"), "earlier")
        .groupBy(F.col("later").alias("item")).agg(F.min_by("earlier", "order").alias("leader"))
    )
    return own.select("item", F.col("item").alias("leader")).unionByName(first)


def _grid(v, side: float):  # noqa: ANN001, ANN202
    return F.floor(v / side).cast("long")


def _tiled(items: DataFrame, side: float, most: int) -> DataFrame:
    """items with their tile and own, true; and once more, own false, for each other tile where points lie in squares that their box meets."""
    dealt = cells(items.select("model_id", "id", "x", "y"), most).withColumnsRenamed({"node": "id", "cell": "tile"})
    items = cut(items.join(dealt, ["model_id", "id"]))
    held = items.select("model_id", "tile", _grid(F.col("x"), side).alias("gx"), _grid(F.col("y"), side).alias("gy")).distinct()
    span = lambda c: F.explode(F.sequence(_grid(F.col(f"min_{c}"), side), _grid(F.col(f"max_{c}"), side)))
    # A model of one tile has no others.
    several = held.groupBy("model_id").agg(F.count_distinct("tile").alias("n")).where("n > 1").select("model_id")
    meets = items.join(several, "model_id", "left_semi").select("model_id", "id", F.col("tile").alias("home"), *BOX).withColumn("gx", span("x")).withColumn("gy", span("y"))
    guests = meets.join(held, ["model_id", "gx", "gy"]).where("tile <> home").select("model_id", "id", "tile").distinct()
    return items.withColumn("own", F.lit(True)).unionByName(items.drop("tile").join(guests, ["model_id", "id"]).withColumn("own", F.lit(False)))


def settled(items: DataFrame, side: float, radius: float | None = None, most: int = ITEMS) -> DataFrame:
    """model_id, id, kept, by: a pass in order that keeps an item unless one kept before stands against it; by is the first that does.

    items has model_id, id, order, a point x, y, z and BOX. An item stands against those of a later order whose point lies in its
    box, borders included; with a radius, only against those no further than it in x and y. side is that of the squares in which
    others are looked up, about the size of a box.
    Items are dealt to tiles of about most; a tile also gets those of other tiles that may stand against its own. A tile's rounds
    end when all of its own are settled.
    """
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("order")
        col = {c: rows.column(c).to_pylist() for c in rows.column_names}
        order, xs, ys, zs, own, known, name = (col[c] for c in ("order", "x", "y", "z", "own", "known", "id"))
        box = list(zip(*(col[c] for c in BOX), strict=True))
        kept_at, open_at, out = defaultdict(list), defaultdict(list), ([], [], [], [])
        for i, (x, y, z) in enumerate(zip(xs, ys, zs, strict=True)):
            spot = math.floor(x / side), math.floor(y / side)

            def against(j: int, i: int = i, x: float = x, y: float = y, z: float = z) -> bool:
                b = box[j]
                return order[j] < order[i] and b[0] <= x <= b[3] and b[1] <= y <= b[4] and b[2] <= z <= b[5] and (radius is None or math.hypot(x - xs[j], y - ys[j]) <= radius)

            by = next(filter(against, kept_at.get(spot, ())), None)
            waits = next(filter(against, open_at.get(spot, ())), None)
            kept = known[i]
            if kept is None and by is not None:
                kept = False
            elif kept is None and waits is None and own[i]:
                kept = True
            if kept or kept is None:
                seen, b = kept_at if kept else open_at, box[i]
                for gx in range(math.floor(b[0] / side), math.floor(b[3] / side) + 1):
                    for gy in range(math.floor(b[1] / side), math.floor(b[4] / side) + 1):
                        seen[gx, gy].append(i)
            if own[i]:
                # Of those refused, the first against them is known once none before it is open.
                sure = kept or (kept is False and by is not None and (waits is None or order[waits] >= order[by]))
                for c, v in zip(out, (name[i], kept, name[by] if kept is False and by is not None else None, bool(sure)), strict=True):
                    c.append(v)
        kinds = (pa.string(), pa.bool_(), pa.string(), pa.bool_())
        return pa.table({"model_id": pa.array([key[0].as_py()] * len(out[0]), pa.string()), **{c: pa.array(v, k) for c, v, k in zip(("id", "kept", "by", "sure"), out, kinds, strict=True)}})

    # What has no place, or none that is finite, stands against nothing and nothing against it.
    placed = F.col("order").isNotNull()
    for c in ("x", "y", "z", *BOX):
        placed &= F.coalesce(F.abs(c) < 1e15, F.lit(False))
    # Computed once: tiles are made from several looks at the items.
    items = cut(items.withColumn("placed", placed))
    free = items.where("NOT placed").select("model_id", "id", F.lit(True).alias("kept"), F.lit(None).cast("string").alias("by"))
    tiles = cut(_tiled(items.where("placed").select("model_id", F.col("id").cast("string").alias("id"), "order", "x", "y", "z", *BOX), side, most))
    passed = lambda df: cut(df.groupBy("model_id", "tile").applyInArrow(run, "model_id string, id string, kept boolean, by string, sure boolean"))
    state = passed(tiles.withColumn("known", F.lit(None).cast("boolean")))
    while not state.where("NOT sure").isEmpty():
        waiting = tiles.where("own").join(state.where("NOT sure").select("model_id", "id"), ["model_id", "id"], "left_semi").select("model_id", "tile").distinct()
        again = tiles.join(waiting, ["model_id", "tile"], "left_semi").join(state.select("model_id", "id", F.col("kept").alias("known")), ["model_id", "id"])
        told = passed(again)
        state = cut(state.join(told.select("model_id", "id"), ["model_id", "id"], "left_anti").unionByName(told))
    return state.drop("sure").unionByName(free)
