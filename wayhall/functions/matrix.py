"""Placements in space as twelve columns: three rows of a rotation and a shift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AXES = range(3)
#: m<row><column>; column 3 is the shift.
CELLS = [f"m{i}{j}" for i in AXES for j in range(4)]


def identity() -> dict[str, Column]:
    return {f"m{i}{j}": F.lit(1.0 if i == j else 0.0) for i in AXES for j in range(4)}


def product(outer: dict[str, Column], inner: dict[str, Column]) -> dict[str, Column]:
    """The placement of what is placed by inner in a system that is placed by outer. Associative."""
    out = {}
    for i in AXES:
        for j in range(4):
            cell = sum((outer[f"m{i}{k}"] * inner[f"m{k}{j}"] for k in (1, 2)), outer[f"m{i}0"] * inner[f"m0{j}"])
            out[f"m{i}{j}"] = cell + outer[f"m{i}3"] if j == 3 else cell
    return out


def moved(m: dict[str, Column], spot: tuple[Column, Column, Column]) -> list[Column]:
    """x, y and z of a spot of the inner system in the outer one."""
    return [m[f"m{i}0"] * spot[0] + m[f"m{i}1"] * spot[1] + m[f"m{i}2"] * spot[2] + m[f"m{i}3"] for i in AXES]


def _dot(a: list[Column], b: list[Column]) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def _cross(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[(i + 1) % 3] * b[(i + 2) % 3] - a[(i + 2) % 3] * b[(i + 1) % 3] for i in AXES]


def _unit(v: list[Column], other: list[Column]) -> list[Column]:
    """v at length 1, or other where v is missing or has no length."""
    size = F.sqrt(_dot(v, v))
    return [F.when(size > 1e-12, c / size).otherwise(o) for c, o in zip(v, other, strict=True)]


def parts(v: Column) -> list[Column]:
    """The first three numbers of an array, 0 for those that it hasn't."""
    return [F.coalesce(F.get(v, F.lit(i)), F.lit(0.0)) for i in AXES]


def framed(df: DataFrame, location: str, axis: str, ref: str) -> DataFrame:
    """df with CELLS for arrays of a place, of the z direction and of a direction near x, each null for its default.

    A step at a time, each a column, so that no expression holds the ones before it many times over.
    """
    array = lambda v: F.array(*v)
    at = lambda name: [F.get(F.col(name), F.lit(i)) for i in AXES]
    fixed = lambda *v: [F.lit(c) for c in v]
    df = df.withColumn("__z", array(_unit(parts(F.col(axis)), fixed(0.0, 0.0, 1.0)))).withColumn("__n", array(_unit(parts(F.col(ref)), fixed(1.0, 0.0, 0.0))))
    # A direction along z says nothing of x; x, or y where z is x, stands in for it.
    spare = [F.when(F.abs(at("__z")[0]) < 0.9, F.lit(c)).otherwise(F.lit(d)) for c, d in ((1.0, 0.0), (0.0, 1.0), (0.0, 0.0))]
    for name, v in (("__f", at("__n")), ("__s", spare)):
        df = df.withColumn("__d", _dot(v, at("__z"))).withColumn(name, array([v[i] - F.col("__d") * at("__z")[i] for i in AXES]))
    df = df.withColumn("__x", array(_unit(at("__f"), at("__s")))).withColumn("__x", array(_unit(at("__x"), at("__x"))))
    x, y, z, place = at("__x"), _cross(at("__z"), at("__x")), at("__z"), parts(F.col(location))
    df = df.withColumns({f"m{i}{j}": c for i in AXES for j, c in enumerate((x[i], y[i], z[i], place[i]))})
    return df.drop("__z", "__n", "__d", "__f", "__s", "__x")
