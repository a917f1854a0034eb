"""Reusable plans against plain Python."""

import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wayhall.functions.text import is_lift_by_text, or_default, stripped
from wayhall.plans.ordered import leaders, refused
from wayhall.plans.overlay import cells, overlay_distances, search
from wayhall.plans.paths import distances, path_steps, routes
from wayhall.plans.spatial import near_boxes, near_points
from wayhall.sources.tables import model_files, require_model


def test_near_boxes_meets_each_pair_once(spark):
    rnd = random.Random(4)
    points = [("m", i, rnd.uniform(-20, 20), rnd.uniform(-20, 20)) for i in range(200)]
    boxes = []
    for i in range(60):
        x, y, w = rnd.uniform(-20, 20), rnd.uniform(-20, 20), rnd.choice([0, 0.3, 2, 30])
        boxes.append(("m", i, x, y, x + w, y + w / 2))
    got = near_boxes(spark.createDataFrame(points, "k string, p long, x double, y double"), spark.createDataFrame(boxes, "k string, b long, min_x double, min_y double, max_x double, max_y double"), ["k"], 1.1)
    inside = F.col("x").between(F.col("min_x") - 1.1, F.col("max_x") + 1.1) & F.col("y").between(F.col("min_y") - 1.1, F.col("max_y") + 1.1)
    pairs = [(r["p"], r["b"]) for r in got.where(inside).collect()]
    want = {(p, b) for _, p, x, y in points for _, b, x0, y0, x1, y1 in boxes if x0 - 1.1 <= x <= x1 + 1.1 and y0 - 1.1 <= y <= y1 + 1.1}
    assert len(pairs) == len(set(pairs)) and set(pairs) == want


def test_near_points(spark):
    rows = spark.createDataFrame([("m", i, float(i), 0.0) for i in range(6)], "k string, i long, x double, y double")
    got = near_points(rows, rows, ["k"], 1.0).where("abs(x - r_x) <= 1").select("i", "r_i").collect()
    assert len(got) == len(set(got)) == 16


def greedy(n, near):
    kept = []
    for i in range(n):
        if not any((j, i) in near for j in kept):
            kept.append(i)
    return kept


@pytest.mark.parametrize("seed", range(3))
def test_ordered_passes(spark, seed):
    rnd, n = random.Random(seed), 40
    spots = [(rnd.uniform(0, 8), rnd.uniform(0, 8)) for _ in range(n)]
    near = {(i, j) for i in range(n) for j in range(i + 1, n) if math.dist(spots[i], spots[j]) <= 2}
    edges = spark.createDataFrame(sorted(near), "earlier long, later long")
    kept = greedy(n, near)
    assert {r[0] for r in refused(edges).collect()} == set(range(n)) - set(kept)
    items = spark.createDataFrame([(i, i) for i in range(n)], "item long, order long")
    got = {r["item"]: r["leader"] for r in leaders(items, edges).collect()}
    assert got == {i: i if i in kept else min(k for k in kept if (k, i) in near) for i in range(n)}


def test_order_matters(spark):
    chain = lambda pairs: {r[0] for r in refused(spark.createDataFrame(pairs, "earlier long, later long")).collect()}
    assert chain([(1, 2), (2, 3)]) == {2} and chain([(2, 1), (2, 3)]) == {1, 3}


def cheapest(edges, start):
    best = {start: 0.0}
    for _ in range(len(edges) + 1):
        for u, v, w in edges:
            for a, b in ((u, v), (v, u)):
                if a in best and best[a] + w < best.get(b, 1e18):
                    best[b] = best[a] + w
    return best


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 7), st.integers(0, 7), st.integers(0, 5)), max_size=20))
def test_shortest_matches_relaxation(edges):
    edges = [(str(u), str(v), float(w)) for u, v, w in edges if u != v]
    adjacent = {}
    for u, v, w in edges:
        adjacent.setdefault(u, []).append((v, w))
        adjacent.setdefault(v, []).append((u, w))
    best = cheapest(edges, "0")
    for node in map(str, range(8)):
        found = search(adjacent, [(0.0, 0, "", "0")]).get(node)
        assert (found is None) == (node not in best)
        if found:
            assert found[0] == best[node] and (node == "0") == (found[2] == "")


def test_distances_and_routes(spark):
    rnd = random.Random(1)
    edges = [(f"n{rnd.randrange(30)}", f"n{rnd.randrange(30)}", float(rnd.randrange(1, 9)), rnd.random() < 0.7) for _ in range(60)]
    edges = [e for e in {frozenset(e[:2]): e for e in edges if e[0] != e[1]}.values()]
    table = spark.createDataFrame([("m", *e) for e in edges], "model_id string, u string, v string, weight double, accessible boolean")
    got = {r["node"]: r["cost"] for r in distances(table, spark.createDataFrame([("m", "n0")], "model_id string, node string")).collect()}
    assert got == cheapest([e[:3] for e in edges], "n0")
    nodes = spark.createDataFrame([("m", f"n{i}") for i in range(30)], "model_id string, id string")
    asked = [("m", i, "n0", f"n{i}", w) for i in range(30) for w in (False, True)] + [("m", 99, "x", "n0", False), ("z", 98, "n0", "n1", None)]
    found = routes(spark.createDataFrame(asked, "model_id string, request_id long, origin string, destination string, wheelchair boolean"), nodes, table).collect()
    best = {w: cheapest([e[:3] for e in edges if e[3] or not w], "n0") for w in (False, True)}
    for r in found:
        if r["request_id"] < 90:
            assert r["total_weight"] == best[r["wheelchair"]].get(r["destination"])
    assert {r["request_id"]: r["status"] for r in found if r["request_id"] > 90} == {99: "unknown_origin", 98: "unknown_model"}


def corridor(spark, n):
    """A row of n nodes, its ids in no order, a step of weight 1 between neighbours and some longer ones beside."""
    name = lambda c: F.concat(F.lit("n"), F.pmod(c * 7919, F.lit(1_000_003)).cast("string"))
    ids = spark.range(n).select(F.lit("m").alias("model_id"), F.col("id"))
    nodes = ids.select("model_id", name(F.col("id")).alias("id"), F.lit("a").alias("level"), F.col("id").cast("double").alias("x"), F.lit(0.0).alias("y"))
    step = lambda d, w: ids.where(F.col("id") < n - d).select("model_id", name(F.col("id")).alias("u"), name(F.col("id") + d).alias("v"), F.lit(w).alias("weight"), F.lit(True).alias("accessible"))
    return nodes, step(1, 1.0).unionByName(step(5, 5.5))


def test_overlay_of_a_long_corridor(spark):
    from wayhall.plans import overlay

    n = 3_000
    nodes, edges = corridor(spark, n)
    source = nodes.where("x = 0").select("model_id", F.col("id").alias("node"))
    rounds, before = [], overlay.cut
    overlay.cut = lambda df: rounds.append(1) or before(df)
    try:
        found = overlay_distances(edges, source, cells(nodes, 1000))
        far = found.join(nodes.withColumnRenamed("id", "node"), "node").where("cost <> x OR hops <> x").count()
        assert far == 0 and found.count() == n
    finally:
        overlay.cut = before
    assert len(rounds) / 2 < n / 30  # each round of a search writes twice


def test_cells(spark):
    rnd = random.Random(2)
    rows = [("small", f"s{i}", "a", 1.0, 1.0) for i in range(9)] + [("m", f"n{i}", rnd.choice("ab"), rnd.gauss(0, 9), rnd.uniform(0, 1)) for i in range(800)]
    rows += [("m", f"k{i}", "c", 5.0, 5.0) for i in range(60)] + [("m", "odd", None, None, math.inf), ("m", "nan", "a", math.nan, 1.0)]
    got = cells(spark.createDataFrame(rows, "model_id string, id string, level string, x double, y double"), 20).collect()
    assert sorted(r["node"] for r in got) == sorted(r[1] for r in rows)
    sizes, inside = {}, {}
    for r in got:
        sizes[r["model_id"], r["cell"]] = sizes.get((r["model_id"], r["cell"]), 0) + 1
        inside.setdefault((r["model_id"], r["cell"]), set()).add(next(x[2] for x in rows if x[1] == r["node"]))
    assert max(sizes.values()) <= 40 and all(len(v) == 1 for v in inside.values()) and sizes["small", ""] == 9
    assert sum(v > 20 for v in sizes.values()) <= 5  # those dealt by hash only


def test_routes_and_paths_through_cells(spark):
    most, rnd = 8, random.Random(6)
    spots = {f"n{i}": (rnd.uniform(0, 10), rnd.uniform(0, 10)) for i in range(30)}
    names = sorted(spots)
    edges = {}
    for a in names:
        for b in sorted(names, key=lambda b: math.dist(spots[a], spots[b]))[1:4]:
            edges[frozenset((a, b))] = (a, b, float(rnd.randrange(1, 6)), rnd.random() < 0.8)
    edges = list(edges.values())
    table = spark.createDataFrame([("m", *e) for e in edges] + [("z", "n0", "n1", 1.0, None)], "model_id string, u string, v string, weight double, accessible boolean")
    nodes = spark.createDataFrame([("m", k, "a", *p) for k, p in spots.items()] + [("z", k, "b", 0.0, 0.0) for k in ("n0", "n1", "n2")], "model_id string, id string, level string, x double, y double")
    asked = [("m", i, rnd.choice(names), rnd.choice(names), rnd.choice((True, False, None))) for i in range(25)] + [("m", 100, "n5", "n5", True), ("z", 101, "n0", "n1", True), ("z", 102, "n0", "n2", False), ("z", 103, "n0", "n9", False), ("m", 104, None, "n1", False)]
    got = routes(spark.createDataFrame(asked, "model_id string, request_id long, origin string, destination string, wheelchair boolean"), nodes, table, most=most).collect()
    assert len(got) == len(asked)
    weight = {w: {} for w in (False, True)}
    for a, b, c, open_ in edges:
        for w in (False, True):
            if open_ or not w:
                weight[w][a, b] = weight[w][b, a] = c
    for r in got:
        if r["model_id"] == "m" and r["request_id"] != 104:
            best = cheapest([(a, b, c) for (a, b), c in weight[r["wheelchair"]].items()], r["origin"])
            assert r["total_weight"] == best.get(r["destination"]) and r["status"] == ("found" if r["destination"] in best else "no_route")
            if r["path"]:
                assert r["path"][0] == r["origin"] and r["path"][-1] == r["destination"]
                assert sum(weight[r["wheelchair"]][s] for s in zip(r["path"], r["path"][1:], strict=False)) == r["total_weight"]
    assert {r["request_id"]: (r["status"], r["path"]) for r in got if r["request_id"] >= 100} == {100: ("found", ["n5"]), 101: ("found", ["n0", "n1"]), 102: ("no_route", []), 103: ("unknown_destination", []), 104: ("unknown_origin", [])}
    mine, start = table.where("model_id = 'm'"), spark.createDataFrame([("m", "n7")], "model_id string, node string")
    plain, over = distances(mine, start), overlay_distances(mine, start, spark.createDataFrame(cells(nodes, most).collect()))
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, over.collect()))
    steps = {}
    for r in path_steps(plain).collect():
        steps.setdefault(r["node"], {})[r["pos"]] = r["step"]
    for r in plain.collect():
        way = [steps[r["node"]][i] for i in range(r["hops"] + 1)]
        assert way[0] == "n7" and way[-1] == r["node"] and sum(weight[False][s] for s in zip(way, way[1:], strict=False)) == r["cost"]


def test_a_long_chain_of_cabins(spark):
    from wayhall.operators.lifts import shafts

    n = 50_000
    cabins = spark.range(n).select(F.lit("m").alias("model_id"), F.format_string("c%06d", "id").alias("element_id"), F.col("id").alias("seq"), (F.col("id") * 1.9).alias("cx"), F.lit(0.0).alias("cy"))
    got = {r["element_id"]: r["leader"] for r in shafts(cabins).collect()}
    assert got == {f"c{i:06d}": f"c{i - i % 2:06d}" for i in range(n)}


def test_ordered_passes_over_many_cells(spark):
    rnd, n = random.Random(5), 300
    spots = [(rnd.uniform(0, 30), rnd.uniform(0, 30)) for _ in range(n)]
    near = sorted((i, j) for i in range(n) for j in range(i + 1, n) if math.dist(spots[i], spots[j]) <= 2)
    own = spark.createDataFrame([(i, f"{int(x // 5)} {int(y // 5)}") for i, (x, y) in enumerate(spots)], "item long, cell string")
    got = {r[0] for r in refused(spark.createDataFrame(near, "earlier long, later long"), own).collect()}
    assert got == set(range(n)) - set(greedy(n, set(near)))


def test_text_rules(spark):
    rows = spark.createDataFrame([(" a\t", None), ("　b\n", ""), ("", "x")], "a string, b string")
    assert [tuple(r) for r in rows.select(stripped(F.col("a")), or_default(F.col("b"), "d")).collect()] == [("a", "d"), ("b", "d"), ("", "x")]
    lift = spark.createDataFrame([(None, None), (" lift ", None), (None, "Forklift"), ("X", "stairs"), ("notdefined", None)], "t string, n string")
    assert [r[0] for r in lift.select(is_lift_by_text(F.col("t"), F.col("n"))).collect()] == [False, True, True, False, True]


def test_model_files(spark, tmp_path):
    (tmp_path / "a.IFC").write_text("x")
    assert model_files(spark, str(tmp_path)).first()["stem"] == "a"
    (tmp_path / "b.txt").write_text("x")
    with pytest.raises(ValueError, match="b.txt"):
        model_files(spark, str(tmp_path))


def test_unknown_model(spark):
    from wayhall.sources.tables import empty_building

    with pytest.raises(LookupError):
        require_model(empty_building(spark), "m")


def test_half_even(spark):
    from wayhall.functions.geometry import half_even

    rnd = random.Random(4)
    values = [0.03125, 0.09375, 2.675, 1.005, 0.125, 0.375, -0.125, 0.15, 12.3455, 1e9 + 0.5, 0.0, 1234567.5] + [rnd.uniform(-1e4, 1e4) for _ in range(300)] + [rnd.randrange(10**6) / 2**rnd.randrange(8) for _ in range(200)]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (2, 3, 4):
        assert [r[0] for r in rows.select(half_even(F.col("v"), digits)).collect()] == [round(v, digits) for v in values]
    odd = spark.createDataFrame([(v,) for v in (math.inf, -math.inf, 1e300, -0.00001, 2.0**53, None, math.nan, 123456789012.34565)], "v double").select(half_even(F.col("v"), 4)).collect()
    assert [r[0] for r in odd[:6]] == [math.inf, -math.inf, 1e300, -0.0, 2.0**53, None] and math.isnan(odd[6][0]) and odd[7][0] == round(123456789012.34565, 4)
    assert [r[0] for r in rows.select(F.call_function("format_number", F.col("v"), F.lit("0.0"))).collect()] == [f"{v:.1f}" for v in values]
