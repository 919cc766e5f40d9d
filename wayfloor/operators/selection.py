"""Selections on display coordinates (row 0 on top) and edits of map cells.  Columns ``gy, gx, height`` are given."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def display_row() -> Column:
    return F.col("height") - 1 - F.col("gy")


def in_rectangle(x1: int, y1: int, x2: int, y2: int) -> Column:
    """Inclusive, corners in any order."""
    return F.col("gx").between(min(x1, x2), max(x1, x2)) & display_row().between(min(y1, y2), max(y1, y2))


def in_polygon(points: list[tuple[float, float]]) -> Column:
    """Even-odd rule on cell centres; fewer than three points select nothing."""
    if len(points) < 3:
        return F.lit(False)
    cx, cy = F.col("gx") + 0.5, display_row() + 0.5
    crossings = F.lit(0)
    for (xa, ya), (xb, yb) in zip(points, points[1:] + points[:1]):
        if ya != yb:
            meets = ((F.lit(ya) > cy) != (F.lit(yb) > cy)) & (cx < (xb - xa) * (cy - ya) / (yb - ya) + xa)
            crossings = crossings + meets.cast("int")
    return crossings % 2 == 1


def apply_selection(cells: DataFrame) -> DataFrame:
    """Outside the selection cells are blocked and neither floor nor traversable."""
    return cells.withColumns({"blocked": F.col("blocked") | ~F.col("sel"), "floor": F.col("floor") & F.col("sel"), "trav": F.col("trav") & F.col("sel")})


def polygon_geometry(vertices: DataFrame) -> DataFrame:
    """``(id, i, x, y)`` -> area, centroid and bounds, by the shoelace sums of the closed outline."""
    order = Window.partitionBy("id").orderBy("i")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nxt = lambda c: F.coalesce(F.lead(c).over(order), F.first(c).over(whole))
    edges = vertices.withColumns({"x2": nxt("x"), "y2": nxt("y")}).withColumn("cross", F.col("x") * F.col("y2") - F.col("x2") * F.col("y"))
    s = edges.groupBy("id").agg(
        F.sum("cross").alias("a"), F.sum((F.col("x") + F.col("x2")) * F.col("cross")).alias("sx"), F.sum((F.col("y") + F.col("y2")) * F.col("cross")).alias("sy"),
        F.min("x").alias("x_min"), F.max("x").alias("x_max"), F.min("y").alias("y_min"), F.max("y").alias("y_max"),
    )
    return s.select("id", (F.abs("a") / 2).alias("area"), (F.col("sx") / (3 * F.col("a"))).alias("cx"), (F.col("sy") / (3 * F.col("a"))).alias("cy"), "x_min", "x_max", "y_min", "y_max")


def brush(cells: DataFrame, edits: DataFrame) -> DataFrame:
    """``cells(gy, gx, pixel)`` after the discs of ``edits(seq, cy, cx, r, val)``; the last stroke over a cell wins."""
    span = lambda c: F.sequence(F.col(c) - F.col("r"), F.col(c) + F.col("r"))
    hit = edits.select("*", F.explode(span("cy")).alias("gy")).select("*", F.explode(span("cx")).alias("gx"))
    hit = hit.where((F.col("gy") - F.col("cy")) ** 2 + (F.col("gx") - F.col("cx")) ** 2 <= F.col("r") ** 2)
    last = hit.groupBy("gy", "gx").agg(F.max_by("val", "seq").alias("__val"))
    return cells.join(last, ["gy", "gx"], "left").withColumn("pixel", F.coalesce("__val", "pixel")).drop("__val")
