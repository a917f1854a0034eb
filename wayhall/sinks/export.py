"""Export of graphs as three layers: Parquet for any size, or a GeoPackage file for one model."""

from __future__ import annotations

import sqlite3
import struct
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayhall.functions.geometry import point

#: Names of the exported layers and of the type of outline lines.
NODE_LAYER, EDGE_LAYER, OUTLINE_LAYER, OUTLINE_TYPE = "nodos", "caminos", "plantas_base", "PlantaBase"


def node_layer(nodes: DataFrame) -> DataFrame:
    return nodes.select(
        "model_id", "seq", point(F.col("x"), F.col("y"), F.col("z")).alias("geometry"), "id", F.col("type").alias("tipo"), F.coalesce("name", F.lit("")).alias("nombre"),
        F.coalesce("level", F.lit("")).alias("level"), F.coalesce("accessible", F.lit(True)).alias("acc"),
    )


def edge_layer(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    ends = lambda n: nodes.select("model_id", F.col("id").alias(n), point(F.col("x"), F.col("y"), F.col("z")).alias(f"p{n}"))
    return edges.join(ends("u"), ["model_id", "u"]).join(ends("v"), ["model_id", "v"]).select(
        "model_id", "seq", F.coalesce("coords", F.array("pu", "pv")).alias("geometry"), F.coalesce("accessible", F.lit(True)).alias("acc"),
        F.coalesce("levels", F.lit("")).alias("levels"), F.coalesce("edge_type", F.lit("")).alias("edge_type"),
    )


def outline_layer(outlines: DataFrame, storeys: DataFrame) -> DataFrame:
    """Outlines at their storey's elevation, 0 for a level that is no storey."""
    at = storeys.select("model_id", F.col("name").alias("level"), "elevation")
    return outlines.join(at, ["model_id", "level"], "left").select(
        "model_id", "seq", F.transform("coords", lambda p: point(p["x"], p["y"], F.coalesce("elevation", F.lit(0.0)))).alias("geometry"), "level", F.lit(OUTLINE_TYPE).alias("tipo")
    )


def layers(graph) -> dict[str, DataFrame]:  # noqa: ANN001
    return {NODE_LAYER: node_layer(graph.nodes), EDGE_LAYER: edge_layer(graph.edges, graph.nodes), OUTLINE_LAYER: outline_layer(graph.outlines, graph.storeys)}


def export_parquet(graph, path: str) -> None:  # noqa: ANN001
    for name, df in layers(graph).items():
        df.write.mode("overwrite").partitionBy("model_id").parquet(f"{path}/{name}")


def _blob(points: Iterable, line: bool) -> bytes:
    """GeoPackage binary of a point or line with z, without a reference system."""
    points = [(p["x"], p["y"], p["z"]) for p in points]
    body = struct.pack("<BI", 1, 1002 if line else 1001) + (struct.pack("<I", len(points)) if line else b"")
    return b"GP\0\1" + struct.pack("<i", 0) + body + b"".join(struct.pack("<ddd", *p) for p in points)


def export_geopackage(graph, model_id: str, stem: str, folder: str) -> str:  # noqa: ANN001
    """Write <stem>_grafo.gpkg with the layers that have rows, and return its path. One model's rows stream to the driver."""
    path = Path(folder) / f"{stem}_grafo.gpkg"
    path.unlink(missing_ok=True)
    with sqlite3.connect(path) as db:
        db.execute("PRAGMA application_id = 1196444487")
        db.execute("PRAGMA user_version = 10300")
        db.execute("CREATE TABLE gpkg_spatial_ref_sys (srs_name TEXT NOT NULL, srs_id INTEGER PRIMARY KEY, organization TEXT NOT NULL, organization_coordsys_id INTEGER NOT NULL, definition TEXT NOT NULL, description TEXT)")
        for name, i in (("Undefined cartesian", -1), ("Undefined geographic", 0)):
            db.execute("INSERT INTO gpkg_spatial_ref_sys VALUES (?, ?, 'NONE', ?, 'undefined', NULL)", (name, i, i))
        db.execute("CREATE TABLE gpkg_contents (table_name TEXT PRIMARY KEY, data_type TEXT NOT NULL, identifier TEXT, description TEXT, last_change TEXT, min_x REAL, min_y REAL, max_x REAL, max_y REAL, srs_id INTEGER)")
        db.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT, geometry_type_name TEXT, srs_id INTEGER, z TINYINT, m TINYINT)")
        for name, df in layers(graph).items():
            df = df.where(F.col("model_id") == model_id).orderBy("seq").drop("model_id", "seq")
            line, made = name != NODE_LAYER, False
            for r in df.toLocalIterator():
                rest = [c for c in df.columns if c != "geometry"]
                if not made:
                    kinds = ", ".join(f"{c} {'BOOLEAN' if c == 'acc' else 'TEXT'}" for c in rest)
                    db.execute(f"CREATE TABLE {name} (fid INTEGER PRIMARY KEY AUTOINCREMENT, geom BLOB, {kinds})")
                    db.execute("INSERT INTO gpkg_contents VALUES (?, 'features', ?, '', '', NULL, NULL, NULL, NULL, 0)", (name, name))
                    db.execute("INSERT INTO gpkg_geometry_columns VALUES (?, 'geom', ?, 0, 1, 0)", (name, "LINESTRING" if line else "POINT"))
                    made = True
                shape = r["geometry"] if line else [r["geometry"]]
                db.execute(f"INSERT INTO {name} (geom, {', '.join(rest)}) VALUES (?{', ?' * len(rest)})", [_blob(shape, line), *(r[c] for c in rest)])
    return str(path)
