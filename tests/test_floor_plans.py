"""Floor plans of levels of many walls."""

from types import SimpleNamespace

from pyspark.sql import functions as F

from wayhall.sinks.payload import floor_plans, upload_responses


def lines(spark, n):
    """Two lines of each of n walls, those of every third wall in an earlier phase, in no order."""
    rows = spark.range(n).withColumn("seg", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("phase", F.when(F.col("id") % 3 == 0, 1).otherwise(2).cast("long"))
    spot = lambda d: F.struct((F.col("id") * 2 + F.col("seg") + d).cast("double").alias("x"), F.lit(0.0).alias("y"))
    seq = F.col("phase") * F.lit(1 << 54) + F.col("id") * 4096 + F.col("seg")
    return rows.select(F.lit("m").alias("model_id"), F.lit("P0").alias("level"), seq.alias("seq"), F.array(spot(0), spot(0.5)).alias("coords")).orderBy(F.xxhash64("seq"))


def test_no_row_grows_with_its_level(spark):
    """A level's lines come in pieces of at most 256 walls; one after another they are the whole level in order."""
    n = 3_000
    made = lines(spark, n)
    found = floor_plans(made).orderBy("piece").collect()
    assert max(len(r["lines"]) for r in found) <= 512
    want = [[[c["x"], c["y"]] for c in r["coords"]] for r in made.orderBy("seq").collect()]
    assert [x for r in found for x in r["lines"]] == want and len(want) == 2 * n


def test_a_response_has_its_levels_whole(spark):
    """Pieces are put together in order."""
    import json

    made = lines(spark, 700)
    empty = lambda schema: spark.createDataFrame([], schema)
    nodes = empty("model_id string, seq long, id string, name string, type string, level string, x double, y double, z double, accessible boolean, width double")
    edges = empty("model_id string, u string, v string, seq long, edge_type string, weight double, accessible boolean, levels string, coords array<struct<x:double,y:double,z:double>>")
    graph = SimpleNamespace(storeys=spark.createDataFrame([("m", "P0", 0.0, 0)], "model_id string, name string, elevation double, seq long"), nodes=nodes, edges=edges, outlines=made)
    body = json.loads(upload_responses(graph, spark.createDataFrame([("m", "a.ifc")], "model_id string, file string")).first()["response"])
    assert body["floorplans"] == {"P0": [[[c["x"], c["y"]] for c in r["coords"]] for r in made.orderBy("seq").collect()]}
