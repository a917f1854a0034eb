"""Passes in order over places, without pairs, against plain Python and on crowds."""

import math
import random

import pytest
from pyspark.sql import functions as F

from wayhall.operators.areas import free_slabs
from wayhall.operators.lifts import shafts
from wayhall.plans.ordered import settled


@pytest.mark.parametrize(("seed", "most"), [(0, 12), (1, 40), (2, 1000)])
def test_settled_by_tiles(spark, seed, most):
    rnd = random.Random(seed)
    spots = [(f"i{i}", rnd.randrange(150), rnd.uniform(-9, 9), rnd.uniform(-9, 9)) for i in range(200)]
    rows = spark.createDataFrame([("m", *s) for s in spots], "model_id string, id string, order long, x double, y double")
    sides = {f"{m}_{c}": F.col(c) + r for m, r in (("min", -2.0), ("max", 2.0)) for c in "xy"}
    got = {r["id"]: (r["kept"], r["by"]) for r in settled(rows.withColumns(sides | {k: F.lit(0.0) for k in ("z", "min_z", "max_z")}), 2.0, 2.0, most).collect()}
    want, kept = {}, []
    for i, o, x, y in sorted(spots, key=lambda s: s[1]):
        near = [(ko, k) for k, ko, kx, ky in kept if ko < o and math.hypot(x - kx, y - ky) <= 2.0]
        want[i] = not near, {k for ko, k in near if ko == min(near)[0]}
        if not near:
            kept.append((i, o, x, y))
    assert got.keys() == want.keys() and all(got[i][0] == k and (got[i][1] in by if by else got[i][1] is None) for i, (k, by) in want.items())


def test_a_crowd_of_cabins(spark):
    """20,000 at one place and one beside: 200 million pairs."""
    n = 20_000
    cabins = spark.range(n).select(F.lit("m").alias("model_id"), F.format_string("c%05d", "id").alias("element_id"), F.col("id").alias("seq"), F.when(F.col("id") == 7, 1.5).otherwise(0.0).alias("cx"), F.lit(0.0).alias("cy"))
    got = shafts(cabins)
    assert got.count() == n and [r[0] for r in got.select("leader").distinct().collect()] == ["c00000"]


def boxes(spark, rows):
    made = spark.createDataFrame(rows, "model_id string, element_id string, seq long, min_x double, min_y double, max_x double, max_y double, min_z double, max_z double")
    return made.withColumns({f"c{c}": (F.col(f"min_{c}") + F.col(f"max_{c}")) / 2 for c in "xyz"})


def test_free_slabs(spark):
    rnd = random.Random(3)
    box = lambda p, i: ("m", f"{p}{i}", i, x := rnd.uniform(0, 40), y := rnd.uniform(0, 40), x + rnd.choice([1, 3, 30]), y + rnd.uniform(1, 4), z := float(rnd.randrange(2) * 4), z + 1)
    slabs, rooms = [box("s", i) for i in range(150)], [box("r", i) for i in range(20)]
    holds = lambda b, s: all(b[lo] - 0.1 <= (s[lo] + s[hi]) / 2 <= b[hi] + 0.1 for lo, hi in ((3, 5), (4, 6), (7, 8)))
    kept = []
    for s in slabs:
        if not any(holds(b, s) for b in rooms + kept):
            kept.append(s)
    assert {r[0] for r in free_slabs(boxes(spark, slabs), boxes(spark, rooms)).select("element_id").collect()} == {s[1] for s in kept} != {s[1] for s in slabs}


def test_a_crowd_of_slabs(spark):
    """20,000 slabs at one place, and as many in as many rooms at another."""
    n = 20_000
    row = lambda p, x: spark.range(n).select(F.lit("m").alias("model_id"), F.format_string(p + "%05d", "id").alias("element_id"), F.col("id").alias("seq"), *(F.lit(v).alias(k) for k, v in {"min_x": x, "min_y": 0.0, "min_z": 0.0, "max_x": x + 4, "max_y": 4.0, "max_z": 1.0, "cx": x + 2, "cy": 2.0, "cz": 0.5}.items()))
    assert [r[0] for r in free_slabs(row("a", 0.0).unionByName(row("b", 50.0)), row("r", 50.0)).select("element_id").collect()] == ["a00000"]


def test_crowds_of_doors_and_flights(spark):
    """20,000 doors at one place, by 20,000 rooms at one: 400 million pairs; 300 flights that end where 300 begin, spread over tasks."""
    from wayhall.operators.doors import door_areas
    from wayhall.operators.verticals import near_flights

    n = 20_000
    doors = spark.range(n).select(F.lit("m").alias("model_id"), F.lit("a").alias("level"), F.format_string("d%05d", "id").alias("id"), F.lit(1.0).alias("x"), F.lit(2.0).alias("y"))
    rooms = spark.range(n).select(F.lit("m").alias("model_id"), F.lit("a").alias("level"), F.format_string("r%05d", "id").alias("id"), *(F.lit(v).alias(k) for k, v in {"x": 1.0, "y": 1.0, "min_x": 0.0, "min_y": 0.0, "max_x": 2.0, "max_y": 2.0}.items()), F.col("id").alias("ord"))
    found = door_areas(doors, rooms)
    assert found.count() == 2 * n and {tuple(r) for r in found.select("area_id", "rank", "d").distinct().collect()} == {("r00000", 1, 0.0), ("r00001", 2, 0.0)}
    flights = spark.range(600).select(F.lit("m").alias("model_id"), F.col("id").cast("string").alias("element_id"), F.col("id").alias("seq"), *(F.when(F.col("id") < 300, a).otherwise(b).alias(c) for c, a, b in (("ex", 0.0, 90.0), ("ey", 0.0, 0.0), ("ez", 3.0, 6.0), ("sx", 50.0, 0.0), ("sy", 0.0, 1.5), ("sz", 0.0, 3.5))))
    assert {tuple(r) for r in near_flights(flights).select(F.col("from_id").cast("int") < 300, F.col("to_id").cast("int") < 300).distinct().collect()} == {(True, False)}
    assert near_flights(flights).distinct().count() == 300 * 300
