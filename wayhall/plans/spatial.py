"""Proximity joins as equi-joins on grid cells.

Boxes may have any size: each goes to the grid level whose cells are at least as wide as the box, so it covers at most
four cells. Points look into every level that has boxes. A point lies in one cell of a level and a box covers a cell
once, so each pair is met once and nothing needs to be made distinct. Exact predicates follow the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


GRID = ["__level", "__gx", "__gy"]


def storey_list(storeys: DataFrame) -> DataFrame:
    """model_id, storeys: each model's storeys as an array; the number of storeys of one building is small."""
    return storeys.groupBy("model_id").agg(F.array_sort(F.collect_list(F.struct("elevation", "seq", "name"))).alias("storeys"))


def nearest_storey(z: Column, storeys: Column = None) -> Column:  # noqa: RUF013
    """Struct name, elevation of the storey nearest to z; ties go to the lower, then to the earlier storey. Null z is 0."""
    storeys = F.col("storeys") if storeys is None else storeys
    z = F.coalesce(z, F.lit(0.0))
    best = F.array_min(F.transform(storeys, lambda s: F.struct(F.abs(s["elevation"] - z).alias("d"), s["elevation"], s["seq"], s["name"])))
    return F.struct(best["name"].alias("name"), best["elevation"].alias("elevation"))


def touched_storeys(low: Column, high: Column, reach: float) -> Column:
    """Storeys with an elevation from low - reach to high + reach, by elevation."""
    return F.filter(F.col("storeys"), lambda s: s["elevation"].between(low - reach, high + reach))


def _cell(v: Column, width: Column) -> Column:
    return F.floor(v / width)


def near_boxes(points: DataFrame, boxes: DataFrame, on: list[str], reach: float, smallest: float = 1.0) -> DataFrame:
    """points joined to boxes (min_x .. max_y) that may lie within reach of (x, y) and agree on the columns on.

    Pairs further away than reach in both coordinates don't come out; the caller tests the rest exactly. Other columns of
    the two sides must have different names.
    """
    points, boxes = _gridded(points, boxes, reach, smallest)
    return points.join(boxes, [*on, *GRID]).drop(*GRID)


def in_some_box(points: DataFrame, boxes: DataFrame, on: list[str], reach: float, where: Column) -> DataFrame:
    """Rows of points for which where holds with some of the boxes that near_boxes() would find, once or more often.

    A semi-join: no pair comes out of it, and a point's search ends at the first box.
    """
    points, boxes = _gridded(points, boxes.distinct(), reach, 1.0)
    keys = [*on, *GRID]
    boxes = boxes.withColumnsRenamed({k: f"__b{k}" for k in keys})
    met = where
    for k in keys:
        met &= F.col(k) == F.col(f"__b{k}")
    return points.join(boxes, met, "left_semi").drop(*GRID)


def _gridded(points: DataFrame, boxes: DataFrame, reach: float, smallest: float) -> tuple[DataFrame, DataFrame]:
    """Both with the columns GRID: the cells that a box covers, and of each level of a box the cell of a point."""
    wide = F.greatest(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y")) + 2 * reach
    level = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(wide, F.lit(1e-9)) / smallest))).cast("int")
    boxes = boxes.withColumn("__level", level)
    # Bounded: a level is the binary logarithm of a size in metres.
    levels = sorted(r[0] for r in boxes.select("__level").distinct().collect() if r[0] is not None)
    width = lambda c: F.pow(F.lit(2.0), c) * smallest
    span = lambda axis: F.sequence(_cell(F.col(f"min_{axis}") - reach, width(F.col("__level"))), _cell(F.col(f"max_{axis}") + reach, width(F.col("__level"))))
    boxes = boxes.withColumn("__gx", F.explode(span("x"))).withColumn("__gy", F.explode(span("y")))
    points = points.withColumn("__level", F.explode(F.array(*(F.lit(v) for v in levels)).cast("array<int>")))
    points = points.withColumn("__gx", _cell(F.col("x"), width(F.col("__level")))).withColumn("__gy", _cell(F.col("y"), width(F.col("__level"))))
    return points, boxes


def near_points(left: DataFrame, right: DataFrame, on: list[str], radius: float, prefix: str = "r_") -> DataFrame:
    """left joined to right points within radius in both coordinates; columns of right, but those of on, get a prefix."""
    boxes = right.select(
        *on,
        *(F.col(c).alias(prefix + c) for c in right.columns if c not in on),
        F.col("x").alias("min_x"), F.col("x").alias("max_x"), F.col("y").alias("min_y"), F.col("y").alias("max_y"),
    )
    return near_boxes(left, boxes, on, radius, max(radius, 1e-6)).drop("min_x", "max_x", "min_y", "max_y")


def first_k(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group (rank from 1)."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)


def first_of(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group, found with map-side combining."""
    rest = [c for c in df.columns if c not in by]
    best = F.min_by(F.struct(*(F.col(c) for c in rest)), F.struct(*order)).alias("__best")
    return df.groupBy(*by).agg(best).select(*by, "__best.*")
