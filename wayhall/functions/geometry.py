"""Geometry of points, boxes and paths as Spark columns. Points are structs x, y (z); boxes min_x .. max_z."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY, SAME = 1e-9, 1e-6


def point(x: Column, y: Column, z: Column | None = None) -> Column:
    parts = {"x": x, "y": y} | ({"z": z} if z is not None else {})
    return F.struct(*(v.cast("double").alias(k) for k, v in parts.items()))


def half_even(v: Column, digits: int) -> Column:
    """v to so many digits, from its exact binary value, ties to the even digit. Spark's own functions round what is printed.

    Only values that a product can't tell from a tie, and very large ones, are formatted. What has no digits to round, such
    as infinity, stays as it is.
    """
    scaled = v * 10.0**digits
    clear = (F.abs(scaled) < 2.0**40) & (F.abs(scaled - F.floor(scaled) - 0.5) > 1e-3)
    exact = F.call_function("format_number", v, F.lit("0." + "#" * digits)).cast("double")
    return F.when(~(F.abs(v) < 2.0**52), v).when(clear, F.rint(scaled) / 10.0**digits).otherwise(exact)


def distance_2d(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.hypot(ax - bx, ay - by)


def in_box_3d(x: Column, y: Column, z: Column, box: str, reach: float) -> Column:
    """Whether a point lies in a box widened by reach on all sides, borders included; box is a column prefix."""
    side = lambda v, c: v.between(F.col(f"{box}min_{c}") - reach, F.col(f"{box}max_{c}") + reach)
    return side(x, "x") & side(y, "y") & side(z, "z")


def in_box_2d(x: Column, y: Column, box: str, reach: float) -> Column:
    side = lambda v, c: v.between(F.col(f"{box}min_{c}") - reach, F.col(f"{box}max_{c}") + reach)
    return side(x, "x") & side(y, "y")


def box_distance_2d(x: Column, y: Column, box: str) -> Column:
    """Distance to a rectangle; 0 inside."""
    gap = lambda v, c: F.greatest(F.col(f"{box}min_{c}") - v, F.lit(0.0), v - F.col(f"{box}max_{c}"))
    return F.hypot(gap(x, "x"), gap(y, "y"))


def unit_2d(x: Column, y: Column) -> Column:
    """The vector at length 1; null if it is shorter than 1e-9."""
    size = F.hypot(x, y)
    return F.when(size >= TINY, point(x / size, y / size))


def principal_axis(n: Column, sxx: Column, syy: Column, sxy: Column) -> Column:
    """Direction of the larger eigenvalue of a scatter matrix; null for fewer than two points."""
    trace, det = sxx + syy, sxx * syy - sxy * sxy
    largest = trace / 2 + F.sqrt(F.greatest(trace * trace / 4 - det, F.lit(0.0)))
    x, y = sxy, largest - sxx
    flat = (F.abs(x) < TINY) & (F.abs(y) < TINY)
    wide = sxx >= syy
    x = F.when(flat, F.when(wide, 1.0).otherwise(0.0)).otherwise(x)
    y = F.when(flat, F.when(wide, 0.0).otherwise(1.0)).otherwise(y)
    return F.when(n >= 2, unit_2d(x, y))


def _through(start: Column, bend: Column, end: Column) -> Column:
    """start, bend and end without points that fall on the one before; always at least start and end."""
    far = lambda a, b: distance_2d(a["x"], a["y"], b["x"], b["y"]) > SAME
    first, second = far(start, bend), far(bend, end)
    return F.when(first & second, F.array(start, bend, end)).when(first, F.array(start, bend)).otherwise(F.array(start, end))


def path_from_door(door: Column, target: Column, normal: Column) -> Column:
    """From a door along its wall's normal, as far as the target lies that way, then straight to the target."""
    along = (target["x"] - door["x"]) * normal["x"] + (target["y"] - door["y"]) * normal["y"]
    return _through(door, point(door["x"] + along * normal["x"], door["y"] + along * normal["y"]), target)


def path_by_corner(start: Column, end: Column, x_first: bool = True) -> Column:
    """An L-shaped path, along x first or along y first."""
    corner = point(end["x"], start["y"]) if x_first else point(start["x"], end["y"])
    return _through(start, corner, end)


def at_height(path: Column, z: Column) -> Column:
    return F.transform(path, lambda p: point(p["x"], p["y"], z))


def straight(*points: Column) -> Column:
    return F.array(*points)
