"""Graphs of models that arrive."""

import json
import random

from pyspark.sql import functions as F

from tests.micro import building
from wayhall.operators.graph import upsert_edges
from wayhall.sources.tables import write_building
from wayhall.streaming.arrivals import build_on_arrival
from wayhall.streaming.upserts import arriving_edges, current_edges


def test_arrival(spark, tmp_path):
    write_building(building(spark, "late"), str(tmp_path / "tables"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text(json.dumps({"model_id": "late"}) + "\n")
    build_on_arrival(spark, str(tmp_path / "tables"), str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out/nodes")).where("model_id = 'late'").count() > 20


def test_upserts_of_shuffled_and_repeated_rows(spark, tmp_path):
    rnd = random.Random(6)
    kind = "model_id string, a string, b string, edge_type string, weight double, accessible boolean, coords array<struct<x:double,y:double,z:double>>, ord long"
    spots = [(0.0, 0.1, 1e-7), (1.0, 2.0, 3.0)]
    rows = [("m", *rnd.sample("pqrs", 2), rnd.choice(("x", None)), rnd.random(), rnd.choice((True, False, None)), spots[: rnd.choice((1, 2, 2, 2))], i) for i in range(60)]
    arriving = rows + rnd.sample(rows, 30)
    rnd.shuffle(arriving)
    source, out, at = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    for part in range(2):  # the second run goes on where the first one stopped
        spark.createDataFrame(arriving[part * 45 : part * 45 + 45], kind).repartition(3).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 2).parquet(str(source))
        arriving_edges(stream, out, at).awaitTermination()
    want = upsert_edges(spark.createDataFrame(rows, kind))
    got = current_edges(spark, out)
    line = lambda df: sorted(r[0] for r in df.select(F.to_json(F.struct("model_id", "a", "b", "seq", "edge_type", "weight", "accessible", "coords"))).collect())
    assert line(got) == line(want) and len(line(want)) == 6
    assert len({r["batch"] for r in spark.read.parquet(out).select("batch").distinct().collect()}) >= 2
