"""Engine queries against their SQL in DuckDB, on the smallest tables where they are there."""

import os

import duckdb
import pytest

from wayhall.bindings.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
QUICK = ["a1_geometry", "a2_main_axis", "j1_storey_snap", "j3_door_areas", "b2_door_edges", "j8_near_flights", "f8_lift_tests", "w3_low_edges", "r3_distances_wheelchair", "k3_route_responses", "d5_assemble_edges"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", QUICK)
def test_query(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    want = con.sql(ORACLES[name])
    got = QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    plain = lambda v: round(float(v), 5) if isinstance(v, float) or type(v).__name__ == "Decimal" else v
    pick = [want.columns.index(c) for c in cols]
    assert sorted(repr([plain(r[c]) for c in cols]) for r in got.collect()) == sorted(repr([plain(r[i]) for i in pick]) for r in want.fetchall())
