"""Requests that share an end, on graphs of several cells."""

import random

import pytest
from pyspark.sql import functions as F

from tests.test_plans import cheapest
from wayhall.plans import paths
from wayhall.plans.trees import trees


@pytest.mark.parametrize("back", [True, False])
def test_requests_that_share_an_end(spark, back, monkeypatch):
    """One tree answers them: no overlay is made, whose shortcuts grow with the square of a cell's border."""
    monkeypatch.setattr(paths, "Overlay", None)
    rnd, side = random.Random(5), 12
    spots = {f"n{x}_{y}": (float(x), float(y)) for x in range(side) for y in range(side)}
    edges = {}
    for a, (x, y) in spots.items():
        for b in (f"n{int(x) + 1}_{int(y)}", f"n{int(x)}_{int(y) + 1}"):
            if b in spots and rnd.random() < 0.85:
                edges[a, b] = float(rnd.choice((0, 1, 2, 50))), rnd.random() < 0.8
    table = spark.createDataFrame([("m", *k, *v) for k, v in edges.items()], "model_id string, u string, v string, weight double, accessible boolean")
    nodes = spark.createDataFrame([("m", k, "a", *p) for k, p in spots.items()], "model_id string, id string, level string, x double, y double")
    hub, others = "n6_6", rnd.sample(sorted(spots), 60) + ["n6_6"]
    asked = [("m", i, *((o, hub) if back else (hub, o)), bool(i % 2)) for i, o in enumerate(others)]
    asked = spark.createDataFrame(asked, "model_id string, request_id long, origin string, destination string, wheelchair boolean")
    got = paths.routes(asked, nodes, table, most=20).collect()
    weight = {w: {k: c for (a, b), (c, o) in edges.items() if o or not w for k in ((a, b), (b, a))} for w in (False, True)}
    best = {w: cheapest([(a, b, c) for (a, b), c in weight[w].items()], hub) for w in (False, True)}
    assert len(got) == len(others) and {r["status"] for r in got} == {"found", "no_route"}
    for r in got:
        other = r["origin"] if back else r["destination"]
        assert r["total_weight"] == best[r["wheelchair"]].get(other)
        if r["status"] == "found":
            assert (r["path"][0], r["path"][-1]) == (r["origin"], r["destination"]) and sum(weight[r["wheelchair"]][s] for s in zip(r["path"], r["path"][1:], strict=False)) == r["total_weight"]


def test_rounds_of_a_tree_are_cells(spark, monkeypatch):
    """A row of 3,000 nodes in 10 cells takes about 10 rounds; costs are those of distances()."""
    from tests.test_plans import corridor
    from wayhall.plans import overlay
    from wayhall.plans import trees as module

    nodes, edges = corridor(spark, 3_000)
    cells = nodes.select("model_id", F.col("id").alias("node"), F.floor(F.col("x") / 300).cast("string").alias("cell"))
    asked = nodes.where("x = 2999 OR x = 1").select("model_id", F.lit(False).alias("wheelchair"), F.lit("n0").alias("hub"), F.col("id").alias("node"))
    cuts = []
    monkeypatch.setattr(module, "cut", lambda df, f=module.cut: cuts.append(1) or f(df))
    found = {r["node"]: r["cost"] for r in trees(edges, cells, asked).collect()}
    assert len(cuts) <= 5 + 3 * 12 and found.keys() >= {r["node"] for r in asked.collect()}
    far = nodes.where("x = 2999").collect()[0]["id"]
    assert found[far] == 2999.0 and overlay.CELL >= 3_000
