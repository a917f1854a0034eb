"""Opening models: STEP statements, instances, placements, shapes, and the micro building from a file."""

import math

import pytest
from pyspark.sql import functions as F

from tests import micro, step_files
from wayhall import schema
from wayhall.functions.matrix import CELLS, framed, product
from wayhall.plans.chains import composed, steps_back
from wayhall.sources import shapes, step
from wayhall.sources.ifc import read_ifc


@pytest.fixture
def small_ranges(spark, request):
    """Byte ranges of a few hundred or thousand bytes, so that a small file has many."""
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, str(request.param))
    yield
    spark.conf.set(key, before)


def plain_statements(text):
    out, now, state = [], "", ""
    i = 0
    while i < len(text):
        two = text[i : i + 2]
        if not state and two == "/*":
            state, i = "/*", i + 2
            continue
        if state == "/*":
            if two == "*/":
                state, i = "", i + 2
            else:
                i += 1
            continue
        c = text[i]
        if c == "'":
            state = "" if state else "'"
        if c == ";" and not state:
            out.append(now)
            now = ""
        else:
            now += c
        i += 1
    return out


ODD = """ISO-10303-21;
HEADER; /* a comment; it's open */ FILE_SCHEMA(('IFC2X3'));
DATA;
#1= IFCWALL ('a;b''c;',$,'/* no comment; */',(#2,#3),.T.,IFCLABEL('x,(y;'));
/* ' ; ' */ #2=IFCDIRECTION((0.,1.E-3,-2.5));#3=IFCX($,*,());
#4=(IFCA()IFCB('z;'));
#5=IFCTEXT('\\X2\\00E90041\\X0\\ \\X\\E9 \\S\\i \\\\ 1'); /* long """ + "; ' " * 400 + """ */
#6=IFCLONG('""" + "w; " * 500 + """',#1);
#7 = IFCEND('multi
line');
ENDSEC;
"""


@pytest.mark.parametrize("small_ranges", [300], indirect=True)
def test_statements_across_ranges(spark, tmp_path, small_ranges):
    texts = {"one.ifc": ODD, "two.ifc": "".join(f"#{i}=IFCA('{';' * (i % 3)}',{i});\n" for i in range(200)), "three.ifc": "#1=IFCA(1);" * 100, "empty.ifc": ""}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    got = {}
    for r in step.statements(spark, str(tmp_path)).collect():
        got.setdefault(r["path"].rsplit("/", 1)[1], []).append(r["value"].strip())
    for name, text in texts.items():
        assert sorted(x for x in got.get(name, []) if x) == sorted(x.strip() for x in plain_statements(text) if x.strip())
    assert step._pieces(spark, str(tmp_path)).select("path", "block").distinct().count() > 12
    found = {r["id"]: r for r in step.instances(step.statements(spark, str(tmp_path / "one.ifc"))).collect()}
    assert found[1]["type"] == "IFCWALL" and found[1]["args"] == ["a;b'c;", None, "/* no comment; */", "(#2,#3)", ".T.", "IFCLABEL('x,(y;')"]
    assert found[3]["args"] == [None, None, "()"] and 4 not in found
    assert found[5]["args"] == ["éA é é \\ 1"] and found[6]["args"] == ["w; " * 500, "#1"] and found[7]["args"] == ["multiline"]
    assert [r["step_schema"] for r in step.schemas(step.statements(spark, str(tmp_path / "one.ifc"))).collect()] == ["IFC2X3"]
    rows = step.instances(step.statements(spark, str(tmp_path / "one.ifc")), ["IFCDIRECTION", "IfcWall"]).select("id", step.numbers(F.get("args", F.lit(0))).alias("n"), step.refs(F.get("args", F.lit(3))).alias("r")).orderBy("id").collect()
    assert rows[0]["r"] == [2, 3] and rows[1]["n"] == [0.0, 0.001, -2.5]


def tables(building):
    elements = [tuple(r)[:3] + tuple(r)[4:] for r in sorted(building.elements.collect(), key=lambda r: r["seq"])]
    points = sorted((r["element_id"], r["vseq"], *(round(r[c], 9) + 0.0 for c in "xyz")) for r in building.vertices.collect())
    rels = [[tuple(r[c] for c in df.columns if c not in ("model_id", "seq", "child_pos")) for r in sorted(df.collect(), key=lambda r: (r["seq"], r["child_pos"] if "child_pos" in df.columns else 0))] for df in (building.rel_fills, building.rel_voids, building.rel_boundary, building.rel_aggregates)]
    return elements, points, rels


def as_in_file(spark):
    """The micro building with what a file says otherwise: the container is a storey of the model."""
    own = micro.building(spark, "micro")
    elements = own.elements.withColumn("container_name", F.when(F.col("container_name") == "Otro", "P2"))
    elements = elements.withColumn("elevation", F.when(F.col("elevation").contains("."), F.col("elevation")).otherwise(F.concat("elevation", F.lit("."))))
    # Types are written as they are, bar their blanks.
    return type(own)(elements.withColumn("predefined_type", F.trim("predefined_type")), own.vertices, own.rel_fills, own.rel_voids, own.rel_boundary, own.rel_aggregates)


@pytest.mark.parametrize("small_ranges", [20000], indirect=True)
def test_micro_building_from_a_file(spark, tmp_path, small_ranges):
    (tmp_path / "micro.ifc").write_text(step_files.micro_file())
    got, want = read_ifc(spark, str(tmp_path)), as_in_file(spark)
    for a, b, what in zip(tables(got), tables(want), ("elements", "vertices", "relations"), strict=True):
        assert a == b, what
    for name, kind in schema.TABLES.items():
        assert [(f.name, f.dataType.simpleString()) for f in getattr(got, name).schema] == [(c.split()[0], {"long": "bigint"}.get(c.split()[1], c.split()[1])) for c in kind.split(", ")]


def test_units_schemas_and_several_files(spark, tmp_path):
    (tmp_path / "mm.ifc").write_text(step_files.micro_file("IFC2X3", 1000.0))
    (tmp_path / "m é+1.ifc").write_text(step_files.micro_file())
    got = read_ifc(spark, str(tmp_path))
    points = {}
    for r in got.vertices.collect():
        points.setdefault(r["model_id"], []).append((r["element_id"], r["vseq"], *(round(r[c], 6) + 0.0 for c in "xyz")))
    assert set(points) == {"mm", "m é+1"} and sorted(points["mm"]) == sorted(points["m é+1"])
    kinds = {(r["model_id"], r["element_id"]): r["predefined_type"] for r in got.elements.collect()}
    assert kinds["m é+1", "L3"] == "ELEVATOR" and kinds["mm", "L3"] is None and kinds["mm", "S1"] == "FLOOR"
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "mm.ifc").write_text("DATA;")
    (tmp_path / "sub" / "mm.ifc").write_text(step_files.micro_file())
    with pytest.raises(ValueError, match="mm"):
        read_ifc(spark, str(tmp_path))


def test_shapes(spark, tmp_path):
    f = step_files.File()
    zero, ref = step_files.Raw, step_files.Ref
    place = step_files.placement(f, None, (10.0, 0.0, 0.0), axis=(0, 1, 0), ref=(1, 0, 0))  # lies on its side
    two = f.add("IFCAXIS2PLACEMENT2D", f.add("IFCCARTESIANPOINT", [1.0, 1.0]), f.add("IFCDIRECTION", [zero("0."), zero("1.")]))
    box = f.add("IFCEXTRUDEDAREASOLID", f.add("IFCRECTANGLEPROFILEDEF", zero(".AREA."), None, two, 4.0, 2.0), None, f.add("IFCDIRECTION", [zero("0."), zero("0."), zero("2.")]), 3.0)
    cut_ = f.add("IFCBOOLEANCLIPPINGRESULT", zero(".DIFFERENCE."), f.add("IFCBOOLEANRESULT", zero(".UNION."), box, ref(1)), ref(1))
    source = f.add("IFCREPRESENTATIONMAP", f.add("IFCAXIS2PLACEMENT3D", f.add("IFCCARTESIANPOINT", [0.0, 0.0, 1.0]), None, None), f.add("IFCSHAPEREPRESENTATION", None, "Body", "Solid", [cut_]))
    target = f.add("IFCCARTESIANTRANSFORMATIONOPERATOR3D", None, None, f.add("IFCCARTESIANPOINT", [0.0, 0.0, 5.0]), zero("2."), None)
    mapped = f.add("IFCMAPPEDITEM", source, target)
    points = [f.add("IFCCARTESIANPOINT", [float(x), float(y), 0.0]) for x, y in ((0, 0), (1, 0), (0, 1), (1, 1))]
    face = lambda *k: f.add("IFCFACE", [f.add("IFCFACEOUTERBOUND", f.add("IFCPOLYLOOP", [points[i] for i in k]), zero(".T."))])
    brep = f.add("IFCFACETEDBREP", f.add("IFCCLOSEDSHELL", [face(0, 1, 2), face(2, 1, 3)]))
    curve = f.add("IFCINDEXEDPOLYCURVE", f.add("IFCCARTESIANPOINTLIST2D", [[0.0, 0.0], [2.0, 0.0], [2.0, 2.0], [0.0, 0.0]]), None, None)
    prism = f.add("IFCEXTRUDEDAREASOLID", f.add("IFCARBITRARYCLOSEDPROFILEDEF", zero(".AREA."), None, curve), None, None, 1.0)
    disc = f.add("IFCEXTRUDEDAREASOLID", f.add("IFCCIRCLEPROFILEDEF", zero(".AREA."), None, None, 2.0), None, None, 1.0)
    for name, items, at in (("map", [mapped], place), ("cut", [cut_], None), ("both", [brep, prism], None), ("disc", [disc], place), ("none", [], place)):
        f.add("IFCSPACE", name, None, None, None, None, at, step_files.shape(f, items))
    f.add("IFCSPACE", "axis", None, None, None, None, place, step_files.shape(f, [box], "Axis"))
    (tmp_path / "s.ifc").write_text(f.text())
    got = {}
    for r in sorted(read_ifc(spark, str(tmp_path)).vertices.collect(), key=lambda r: (r["element_id"], r["vseq"])):
        got.setdefault(r["element_id"], []).append(tuple(round(r[c], 6) + 0.0 for c in "xyz"))
    corners = [(1 - y, 1 + x) for x, y in ((-2, -1), (2, -1), (2, 1), (-2, 1))]
    plain = [(x, y, z) for z in (0, 3) for x, y in corners]
    assert got["cut"] == [tuple(map(float, p)) for p in plain]
    # Twice as large and 5 up; then z is the world's y, x stays, so y is -z.
    assert got["map"] == [(10.0 + 2 * x, 5.0 + 2 * (z + 1), -2.0 * y + 0.0) for x, y, z in plain]
    flat = [(0, 0, 0), (1, 0, 0), (0, 1, 0), (1, 1, 0)]
    assert got["both"] == [tuple(map(float, p)) for p in [*flat, *((x, y, z) for z in (0, 1) for x, y in ((0, 0), (2, 0), (2, 2)))]]
    assert len(got["disc"]) == 64 and all(math.isclose(math.hypot(x - 10, z), 2, abs_tol=1e-5) and y in (0, 1) for x, y, z in got["disc"])
    assert "none" not in got and "axis" not in got


def plain_product(a, b):
    m = lambda x: [[x[4 * i + j] for j in range(4)] for i in range(3)] + [[0, 0, 0, 1]]
    a, b = m(a), m(b)
    return [sum(a[i][k] * b[k][j] for k in range(4)) for i in range(3) for j in range(4)]


def test_long_chains_of_placements(spark):
    turn = [0.0, -1.0, 0.0, 2.0, 1.0, 0.0, 0.0, -1.0, 0.0, 0.0, 1.0, 0.5]
    own = [[float(x) for x in turn], [1.0, 0.0, 0.0, 3.0, 0.0, 0.0, -1.0, 1.0, 0.0, 1.0, 0.0, 2.0]]
    rows = [("m", i, i - 1 if i % 50 else None, *own[i % 2]) for i in range(150)] + [("m", 500, 999, *own[0])]
    links = spark.createDataFrame(rows, "model_id string, node long, up long, " + ", ".join(f"{c} double" for c in CELLS))
    got = {r["node"]: [r[c] for c in CELLS] for r in composed(links, ["model_id"], CELLS, product).collect()}
    want = {500: own[0]}
    for i in range(150):
        want[i] = plain_product(want[i - 1], own[i % 2]) if i % 50 else own[i % 2]
    assert got == want
    with pytest.raises(ValueError, match="itself"):
        composed(links.withColumn("up", F.when(F.col("node") == 0, F.lit(49)).otherwise(F.col("up"))), ["model_id"], CELLS, product)


def test_frames(spark):
    odd = [(None, None, None), ([1.0, 2.0], [0.0, 0.0, 2.0], [1.0, 1.0, 5.0]), ([1.0, 2.0, 3.0], [1.0, 0.0, 0.0], [3.0, 0.0, 0.0]), (None, [0.0, 0.0, 0.0], [0.0, 0.0, 1.0])]
    rows = framed(spark.createDataFrame(odd, "l array<double>, a array<double>, r array<double>"), "l", "a", "r").select(*CELLS).collect()
    for r, (at, axis, _) in zip(rows, odd, strict=True):
        m = [[r[f"m{i}{j}"] for j in range(3)] for i in range(3)]
        for a in range(3):
            for b in range(3):
                assert math.isclose(sum(m[i][a] * m[i][b] for i in range(3)), float(a == b), abs_tol=1e-12)
        assert [r[f"m{i}3"] for i in range(3)] == [*(at or [0.0]), 0.0, 0.0][:3]
        if axis and any(axis):
            assert [m[i][2] for i in range(3)] == [c / math.hypot(*axis) for c in axis]


def test_steps_back(spark):
    rows = [("a", f"n{i}", f"n{i - 1}" if i else "") for i in range(37)] + [("b", "x", None), ("b", "y", "x")]
    pointers = spark.createDataFrame(rows, "k string, node string, before string")
    got = sorted(map(tuple, steps_back(pointers, ["k"]).collect()))
    assert got == sorted([("a", f"n{i}", f"n{j}", i - j) for i in range(37) for j in range(i + 1)] + [("b", "x", "x", 0), ("b", "y", "y", 0), ("b", "y", "x", 1)])
    only = steps_back(pointers, ["k"], spark.createDataFrame([("a", "n36")], "k string, node string")).collect()
    assert len(only) == 37
    with pytest.raises(ValueError, match="itself"):
        steps_back(spark.createDataFrame([("a", "x", "y"), ("a", "y", "x")], "k string, node string, before string"), ["k"])


def test_property_values(spark):
    values = {"IFCBOOLEAN(.T.)": True, "IFCBOOLEAN(.F.)": False, "IFCLABEL('')": False, "IFCLABEL('No')": True, "IFCINTEGER(0)": False, "IFCREAL(0.)": False, "IFCINTEGER(10)": True, "IFCLOGICAL(.U.)": True, None: None}
    from wayhall.sources.ifc import _truth

    rows = spark.createDataFrame([(k,) for k in values], "v string").select("v", _truth(F.col("v")).alias("t")).collect()
    assert {r["v"]: r["t"] for r in rows} == values


def test_scales(spark):
    rows = [("a", 1, "IFCSIUNIT", [None, ".LENGTHUNIT.", ".MILLI.", ".METRE."]), ("a", 2, "IFCSIUNIT", [None, ".AREAUNIT.", None, ".SQUARE_METRE."]), ("a", 3, "IFCUNITASSIGNMENT", ["(#1,#2)"]),
            ("b", 1, "IFCSIUNIT", [None, ".LENGTHUNIT.", None, ".METRE."]), ("b", 2, "IFCMEASUREWITHUNIT", ["IFCLENGTHMEASURE(0.3048)", "#1"]), ("b", 3, "IFCCONVERSIONBASEDUNIT", ["#9", ".LENGTHUNIT.", "FOOT", "#2"]), ("b", 4, "IFCUNITASSIGNMENT", ["(#3)"])]
    inst = spark.createDataFrame(rows, "model_id string, id long, type string, args array<string>")
    assert {tuple(r) for r in shapes.unit_scales(inst).collect()} == {("a", 0.001), ("b", 0.3048)}
