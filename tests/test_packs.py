"""Dense graphs of several cells."""

import random

from tests.test_plans import cheapest
from wayhall.plans import trees as module
from wayhall.plans.overlay import cells


def test_rounds_handle_nodes_not_arcs(spark, monkeypatch):
    """Where most nodes are neighbours, what is computed and kept for the rounds has a row for a node or a cell, none for an arc."""
    rnd, n = random.Random(3), 90
    edges = [(f"n{a}", f"n{b}", float(rnd.choice((0, 1, 7, 30))), rnd.random() < 0.3) for a in range(n) for b in range(a) if rnd.random() < 0.8]
    edges += [("n0", "x", 2.0, True), ("n0", "x", 1.0, True)]
    table = spark.createDataFrame([("m", *e) for e in edges], "model_id string, u string, v string, weight double, accessible boolean")
    names = [*(f"n{i}" for i in range(n)), "x", "alone"]
    cell = spark.createDataFrame([("m", k, str(i % 3)) for i, k in enumerate(names)], "model_id string, node string, cell string")
    asked = spark.createDataFrame([("m", w, hub, k) for w in (False, True) for hub in ("n5", "alone") for k in names], "model_id string, wheelchair boolean, hub string, node string")
    rows = []
    monkeypatch.setattr(module, "cut", lambda df, f=module.cut: (made := f(df), rows.append(made.count()))[0])
    found = {(r["wheelchair"], r["hub"], r["node"]): r["cost"] for r in module.trees(table, cell, asked).collect()}
    want = {(False, "alone", "alone"): 0.0, (True, "alone", "alone"): 0.0}
    for w in (False, True):
        want |= {(w, "n5", k): c for k, c in cheapest([e[:3] for e in edges if e[3] or not w], "n5").items()}
    assert found == want and max(rows) <= 2 * 3 * len(names) < len(edges)


def test_cells_are_the_largest_tiles_that_fit(spark):
    """Tiles above that hold too many tell a spot's tile: nodes of one quarter that fits stay together, one level that fits is a cell."""
    spots = [("a", float(x), float(y)) for x in range(8) for y in range(8)] + [("b", float(i), 0.0) for i in range(10)] + [("c", 0.0, 0.0)] * 45
    nodes = spark.createDataFrame([("m", f"n{i}", *s) for i, s in enumerate(spots)], "model_id string, id string, level string, x double, y double")
    got = {r["node"]: r["cell"] for r in cells(nodes, 20).collect()}
    assert {got[f"n{i}"] for i in range(64, 74)} == {"b"}
    quarters = {got[f"n{i}"]: (x // 4, y // 4) for i, (_, x, y) in enumerate(spots[:64])}
    assert len(quarters) == 4 and all(quarters[got[f"n{i}"]] == (x // 4, y // 4) and got[f"n{i}"].startswith("a/2/") for i, (_, x, y) in enumerate(spots[:64]))
    assert {got[f"n{i}"].split("/")[1] for i in range(74, 119)} == {"*"} and len({got[f"n{i}"] for i in range(74, 119)}) <= 3
