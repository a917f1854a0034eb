"""Steps that have to grow no faster than their tables: how often rows are read, how they are dealt, what is looked for once."""

import re

from pyspark.sql import functions as F

from wayhall.operators.base import geometry, of_elements
from wayhall.operators.doors import mesh_axes
from wayhall.operators.outline import low_edges, outlines
from wayhall.operators.verticals import end_nodes
from wayhall.plans.spatial import storey_list


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def walls(spark, n):
    return spark.range(n).select(
        F.lit("m").alias("model_id"), F.concat(F.lit("w"), "id").alias("element_id"), F.col("id").alias("seq"), F.lit("IfcWall").alias("ifc_class"), (F.col("id") % 2 == 0).alias("is_external"),
        F.lit(None).cast("string").alias("container_class"), F.lit(None).cast("string").alias("container_name"),
    )


def corners(walls):
    spots = F.array(*(F.struct(*(F.lit(float(v)).alias(k) for k, v in zip("xyz", p, strict=True))) for p in ((0, 0, 0), (3, 0, 0), (3, 1, 0), (0, 1, 2))))
    return walls.select("model_id", "element_id", F.posexplode(spots).alias("vseq", "p")).select("model_id", "element_id", "vseq", "p.*")


def test_outlines_draw_walls_once(spark):
    """Vertices are read to be counted, for their bounds, and for the walls that are drawn."""
    read = spark.sparkContext.accumulator(0)

    def told(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    made = walls(spark, 40)
    points = corners(made)
    points = points.mapInArrow(told, points.schema)
    levels = storey_list(spark.createDataFrame([("m", "P0", 0.0, 0)], "model_id string, name string, elevation double, seq long"))
    bounds = spark.createDataFrame([("m", 5, "w1")], "model_id string, seq long, element_id string")
    found = outlines(made, points, bounds, geometry(points), levels)
    assert {r[0] for r in found.select("element_id").distinct().collect()} == {"w1", *(f"w{i}" for i in range(0, 40, 2))} and found.count() == 21 * 3
    assert read.value <= 6 * 160


def test_tasks_of_meshes_do_not_grow(spark):
    """More vertices make more partitions, not larger ones, and they are dealt once."""
    rows = spark.range(9 << 20).select("id", (F.col("id") % 4).cast("int").alias("vseq"), *(F.rand(1).alias(c) for c in "xyz"))
    rows = rows.select(F.concat(F.lit("m"), (F.col("id") % 2).cast("string")).alias("model_id"), F.concat(F.lit("w"), (F.col("id") / 4).cast("long")).alias("element_id"), "vseq", *"xyz")
    for df in (low_edges(rows), mesh_axes(rows)):
        assert re.findall(r"hashpartitioning\([^()]*, (\d+)\)", plan(df)) == ["10"]


def test_what_is_wanted_is_computed_once(spark):
    """Not once for each table of a union."""
    made = walls(spark, 20)
    points = corners(made.where("seq < 5")).unionByName(corners(made.where("seq >= 5"))).unionByName(corners(made.where("seq > 15")))
    picked = of_elements(points, made.where("seq % 10 = 4"))
    assert len(re.findall(r"Join", plan(picked))) == 1 and picked.count() == 2 * 4
    ends = made.select("*", *(F.lit(1.0).alias(f"{p}{c}") for p in "se" for c in "xyz"), *(F.lit("P0").alias(f"level_{p}") for p in "se"), *(F.lit(0.0).alias(f"elev_{p}") for p in "se"))
    nodes = end_nodes(ends, "Escalera")
    assert "Union" not in plan(nodes) and nodes.where("seq = 3").orderBy("id").select("id", "type").collect() == [("w3_END", "Escalera"), ("w3_START", "Escalera")]


def test_upserts_are_joined_before_they_are_shuffled(spark, tmp_path):
    """Writes of a key come to one row where they are read; no row of the stream goes through Python."""
    from wayhall.streaming.upserts import latest

    stream = spark.readStream.schema("k string, ord long, v double").parquet(str(tmp_path))
    asked = latest(stream, ["k"], "ord", ["v"])._jdf.queryExecution().analyzed().toString()
    assert "Aggregate" in asked and "Pandas" not in asked


def test_chains_of_small_groups_take_no_rounds(spark):
    """Groups are composed in one task each, large ones in rounds; chains that come back to themselves are found in both."""
    import pytest

    from wayhall.plans.chains import composed

    rows = [("a", i, i - 1 if i % 700 else None, 1.0, float(i)) for i in range(2000)] + [("b", i, i + 1 if i < 39 else 99, 2.0, 1.0) for i in range(40)]
    links = spark.createDataFrame(rows, "g string, node long, up long, m double, s double")
    join = lambda above, own: {"m": above["m"] * own["m"], "s": above["m"] * own["s"] + above["s"]}
    want = {("a", i): (1.0, float(sum(range(i - i % 700, i + 1)))) for i in range(2000)} | {("b", i): (2.0 ** (40 - i), 2.0 ** (40 - i) - 1) for i in range(40)}
    sc = spark.sparkContext
    for most in (50, 1 << 16):
        sc.setJobGroup(f"composed-{most}", "")
        got = {(r["g"], r["node"]): (r["m"], r["s"]) for r in composed(links, ["g"], ["m", "s"], join, most=most).collect()}
        assert got == want
    assert len(sc.statusTracker().getJobIdsForGroup("composed-65536")) <= 16
    sc.setJobGroup("rest", "")
    with pytest.raises(ValueError, match="itself"):
        composed(links.where("g = 'b'").withColumn("up", F.when(F.col("node") == 39, 0).otherwise(F.col("up"))), ["g"], ["m", "s"], join)


def test_files_are_read_for_what_is_asked(spark, tmp_path, monkeypatch):
    """Statements are made once; elements and relations need no shapes, vertices no elements."""
    from tests import step_files
    from wayhall.sources import ifc

    (tmp_path / "micro.ifc").write_text(step_files.micro_file("IFC2X3"))
    made = []
    monkeypatch.setattr(ifc, "instances", lambda *a, f=ifc.instances, **k: made.append(k) or f(*a, **k))
    monkeypatch.setattr(ifc, "world_vertices", None)
    elements = ifc.read_elements(spark, str(tmp_path))
    assert made == [{"header": True}] and elements.where("ifc_class = 'IfcTransportElement' AND predefined_type IS NULL").count() == elements.where("ifc_class = 'IfcTransportElement'").count() > 0
    assert ifc.read_relations(spark, str(tmp_path))["rel_fills"].count() > 0
