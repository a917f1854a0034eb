"""The micro building: expected nodes, edges, outlines, routes and payloads."""

import json
import sqlite3

import pytest

from tests.micro import M, building
from wayhall.api import Graph, build_graph, route
from wayhall.operators.graph import summary, usable_edges
from wayhall.sinks.export import export_geopackage, layers
from wayhall.sinks.payload import shown_edges, shown_nodes, upload_responses, write_responses


@pytest.fixture(scope="module")
def made(spark):
    return build_graph(building(spark))


@pytest.fixture(scope="module")
def nodes(made):
    return {r["id"]: r for r in made.nodes.collect()}


@pytest.fixture(scope="module")
def edges(made):
    return {frozenset((r["u"], r["v"])): r for r in made.edges.collect()}


def test_storeys(made):
    rows = sorted((r["elevation"], r["name"], r["seq"]) for r in made.storeys.collect())
    assert rows == [(0.0, "P0", 0), (3.0, "P1", 1), (6.0, "P2", 2)]  # stripped; the last elevation at the first place


def test_areas(nodes):
    assert {k for k, r in nodes.items() if r["type"] in ("Habitacion", "Suelo")} == {"A", "B", "C", "T", "S1", "S6", "S8"}
    assert nodes["B"]["name"] == "Estancia" and nodes["S1"]["name"] == "Suelo/Pasillo"
    assert (nodes["T"]["level"], nodes["T"]["z"]) == ("P0", 0.0)  # midway goes to the lower storey
    assert (nodes["C"]["x"], nodes["C"]["y"], nodes["C"]["z"]) == (4.0, 2.0, 3.0)


def test_doors(nodes):
    assert [nodes[d]["accessible"] for d in ("D1", "D2", "D3", "D4")] == [True, False, True, True]
    axis = lambda d: tuple(round(nodes[d][c], 9) for c in ("wall_axis_x", "wall_axis_y", "wall_normal_x", "wall_normal_y"))
    assert axis("D1") == (0, 1, -1, 0)  # its first wall host; a slab isn't one
    assert axis("D2") == (1, 0, 0, 1) and axis("D3") == (1, 0, 0, 1)
    assert nodes["D3"]["name"] == "Puerta"


def test_vertical_nodes(nodes):
    assert [(nodes[f"F1_{e}"]["z"], nodes[f"F1_{e}"]["level"], nodes[f"F1_{e}"]["accessible"]) for e in ("START", "END")] == [(0, "P0", False), (1.5, "P0", False)]
    assert {k for k in nodes if k.startswith("R")} == {"R1_START", "R1_END"}  # a rise of 0.14 is none
    assert {k for k in nodes if k.startswith("L")} == {f"L1_P{i}" for i in range(3)} | {f"L6_P{i}" for i in range(3)} | {"L3_P0", "L3_P1"}
    assert nodes["L3_P1"]["x"] == 41.5  # mean of the two cabins near the first


def test_edges(edges):
    kinds = {}
    for pair, r in edges.items():
        kinds.setdefault(r["edge_type"], set()).add(tuple(sorted(pair)))
    assert kinds == {
        "puerta_espacio": {("A", "D1"), ("B", "D1"), ("B", "D2"), ("C", "D4")},
        "escalera": {("F1_END", "F1_START"), ("F2_END", "F2_START"), ("F3_END", "F3_START")},
        "escalera_rellano": {("F1_END", "F2_START"), ("F2_END", "F3_START")},
        "rampa": {("R1_END", "R1_START")},
        "vertical_espacio": {("A", "F1_START"), ("A", "F1_END"), ("A", "F2_START"), ("C", "F2_END"), ("C", "F3_START"), ("B", "R1_START"), ("B", "R1_END")},
        "vertical_puerta": {("D2", "L1_P0"), ("D4", "L1_P1"), ("D3", "L6_P0")},
        "ascensor": {("L1_P0", "L1_P1"), ("L1_P1", "L1_P2"), ("L6_P0", "L6_P1"), ("L6_P1", "L6_P2"), ("L3_P0", "L3_P1")},
    }
    e = lambda a, b: edges[frozenset((a, b))]
    assert (e("B", "D2")["weight"], e("B", "D2")["accessible"]) == (999999.0, False)
    assert (e("D2", "L1_P0")["weight"], e("D2", "L1_P0")["accessible"]) == (1.0, True)  # a lift's door link ignores width
    assert (e("F1_END", "F2_START")["weight"], round(e("F2_END", "F3_START")["weight"], 9)) == (0.5, 0.6)
    assert e("F2_START", "F2_END")["levels"] == "P0|P1"
    assert (e("A", "D1")["u"], e("A", "D1")["coords"][0]["x"]) == ("A", 4.0)  # u was there first, the path starts at the door
    assert [tuple(p) for p in e("C", "D4")["coords"]] == [(7, 4, 3), (4, 4, 3), (4, 2, 3)]
    assert [tuple(p) for p in e("C", "F2_END")["coords"]] == [(1.5, 1, 3), (4, 1, 3), (4, 2, 3)]


def test_outlines(made):
    rows = {(r["level"], r["element_id"], *(tuple(p) for p in r["coords"])) for r in made.outlines.collect()}
    assert rows == {
        ("P0", "W2", (0, 0), (3, 3)), ("P0", "W2", (3, 3), (0, 0.1)),  # the closing edge of 0.1 is too short
        ("Otro", "W1", (4, 0), (4, 4)),
        ("P1", "W3", (50, 0), (55, 0)),
    }


def test_routes(made):
    by_stairs = route(made, M, "A", "C").first()
    assert by_stairs["found"] and by_stairs["path"][0] == "A" and by_stairs["path"][-1] == "C"
    assert by_stairs["total_weight"] == 1000001.0 - 1 + 1  # one flight and two links
    assert not route(made, M, "A", "C", wheelchair=True).first()["found"]
    same = route(made, M, "A", "A").first()
    assert (same["path"], same["total_weight"], same["message"]) == (["A"], 0.0, "Ruta encontrada · 1 nodos · coste 0.0")
    with pytest.raises(ValueError, match="destination"):
        route(made, M, "A", "nowhere")
    with pytest.raises(LookupError):
        route(made, "other", "A", "B")
    assert usable_edges(made.edges, True).where("NOT accessible").isEmpty()


def test_payloads_and_export(made, spark, tmp_path):
    shown = {r["id"]: r for r in shown_nodes(made.nodes).collect()}
    assert shown["D1"]["width"] == 0.9 and shown["D3"]["width"] is None and shown["A"]["width"] is None
    bare = made.edges.limit(1).withColumn("coords", made.edges["coords"].cast("array<struct<x:double,y:double,z:double>>")).selectExpr("model_id", "seq", "u", "v", "edge_type", "accessible", "levels", "weight", "CAST(NULL AS array<struct<x:double,y:double,z:double>>) AS coords")
    assert len(shown_edges(bare, made.nodes).first()["coords"]) == 2
    body = json.loads(upload_responses(made, spark.createDataFrame([(M, "casa.ifc")], "model_id string, file string")).first()["response"])
    assert body["storeys"] == ["P0", "P1", "P2"] and body["filename"] == "casa.ifc" and len(body["nodes"]) == len(shown)
    assert set(body["floorplans"]) == {"P0", "P1", "Otro"}
    write_responses(made, spark.createDataFrame([(M, "casa.ifc"), ("none", "a \"b\".ifc")], "model_id string, file string"), str(tmp_path / "bodies"), 7)
    read = lambda m: json.loads("".join(p.read_text() for p in sorted((tmp_path / f"bodies/model_id={m}").glob("part-*"))))
    assert read(M) == body and len(list((tmp_path / f"bodies/model_id={M}").glob("part-*"))) > 3
    assert read("none") == {"session_id": "none", "filename": 'a "b".ifc', "storeys": [], "nodes": [], "edges": [], "floorplans": {}}
    counts = {r["what"]: r["n"] for r in summary(made.nodes, made.edges).collect()}
    assert (counts["areas"], counts["puerta"], counts["escalera"], counts["rampa"], counts["ascensor"]) == (7, 4, 3, 1, 3)
    path = export_geopackage(made, M, "casa", str(tmp_path))
    with sqlite3.connect(path) as db:
        assert {r[0] for r in db.execute("SELECT table_name FROM gpkg_contents")} == {"nodos", "caminos", "plantas_base"}
        assert db.execute("SELECT count(*) FROM caminos").fetchone()[0] == counts["edges"]
    outline = layers(made)["plantas_base"].where("level = 'Otro'").first()
    assert outline["geometry"][0]["z"] == 0.0  # a level that is no storey


def test_graph_round_trip(made, tmp_path, spark):
    from wayhall.api import read_graph

    Graph(*(getattr(made, k).limit(5) for k in ("storeys", "nodes", "edges", "outlines"))).write(str(tmp_path / "g"))
    assert read_graph(spark, str(tmp_path / "g")).nodes.count() == 5


def test_empty_building(spark):
    from wayhall.sources.tables import empty_building

    made = build_graph(empty_building(spark))
    assert made.nodes.isEmpty() and made.edges.isEmpty() and made.outlines.isEmpty()
