"""How much floor a robot can reach: inflation, components, scores, removal what-ifs.

Cells come dense, ``(gy, gx, blocked, floor)``, with an optional small integer
column ``by`` for scenarios or levels, all of which are computed in one job.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfloor.functions.shared import saved
from wayfloor.operators import components as C
from wayfloor.operators import grid as G
from wayfloor.streaming.replay import numbered


def reach(cells: DataFrame, rx: int, ry: int, by: str | None = None) -> DataFrame:
    """Adds ``accessible``: in the largest component of what stays free after inflating obstacles by a rectangle, and floor."""
    keys = [by] if by else []
    grown = saved(G.dilate_rectangle(cells, "blocked", rx, ry, tuple(keys)).select(*keys, "gy", "gx", F.col("blocked").alias("inflated")))
    best = C.largest(C.components(grown.where(~F.col("inflated")).select(*keys, "gy", "gx"), by=by), by).select(*keys, "gy", "gx").withColumn("__in", F.lit(True))
    joined = cells.join(best, [*keys, "gy", "gx"], "left")
    return joined.withColumn("accessible", F.coalesce("__in", F.lit(False)) & F.col("floor")).drop("__in")


def reach_from(cells: DataFrame, rx: int, ry: int, start_gy: int, start_gx: int) -> DataFrame:
    """The component of the free cell nearest to the start (Manhattan, first in row order); the largest if there is none."""
    grown = G.dilate_rectangle(cells, "blocked", rx, ry)
    labelled = saved(C.components(grown.where(~F.col("blocked")).select("gy", "gx")))
    far = F.abs(F.col("gy") - start_gy) + F.abs(F.col("gx") - start_gx)
    seed = labelled.agg(F.min_by("component", F.struct(far, "gy", "gx")).alias("component"))
    return labelled.join(F.broadcast(seed), "component", "left_semi").select("gy", "gx")


def halo(cells: DataFrame, physical: int, inflated: int) -> DataFrame:
    """Cells that only the extra inflation blocks."""
    a = G.dilate_rectangle(cells, "blocked", inflated, inflated).select("gy", "gx", F.col("blocked").alias("wide"))
    b = G.dilate_rectangle(cells, "blocked", physical, physical).select("gy", "gx", F.col("blocked").alias("near"))
    return a.join(b, ["gy", "gx"]).where(F.col("wide") & ~F.col("near")).select("gy", "gx")


def layered(scored: DataFrame) -> DataFrame:
    """``(scenario, rii, accessible_area)`` with the gain over the layer before."""
    order = Window.orderBy("scenario")
    gain = lambda c: F.coalesce(F.col(c) - F.lag(c).over(order), F.lit(0.0))
    return scored.select("*", gain("rii").alias("rii_gain"), gain("accessible_area").alias("area_gain"))


def removable_objects(cells: DataFrame, labels: DataFrame, dimension: DataFrame) -> DataFrame:
    """``(label, gy, gx, component)``: blocked cells of labels that are not fixed, by components of one label."""
    names = dimension.where(F.col("fixation") != "Fixed")
    objects = cells.where("blocked").select("gy", "gx").join(labels.select("gy", "gx", "label"), ["gy", "gx"]).join(F.broadcast(names.select("label")), "label", "left_semi")
    return C.components(objects.select("label", "gy", "gx"), by="label")


def selected_objects(objects: DataFrame, dimension: DataFrame, fixations: list[str], selected: DataFrame, share: float = 0.5) -> DataFrame:
    """Objects of some fixation groups of which at least ``share`` of the cells are ``selected(gy, gx)``: ``(label, component, cells)``."""
    names = dimension.where(F.col("fixation").isin(fixations)).select("label")
    at = objects.join(F.broadcast(names), "label", "left_semi").join(selected.select("gy", "gx").withColumn("__on", F.lit(1)), ["gy", "gx"], "left")
    found = at.groupBy("label", "component").agg(F.count(F.lit(1)).alias("cells"), F.avg(F.coalesce("__on", F.lit(0)).cast("double")).alias("__share"))
    return found.where(F.col("__share") >= share).drop("__share")


def removal_candidates(cells: DataFrame, labels: DataFrame, dimension: DataFrame, resolution: float, margin: int, least_area: float = 0.04) -> DataFrame:
    """All objects whose removal could open floor, ranked from 1, the best.

    Objects are components of blocked cells of one removable label; what an
    object may open is the floor not accessible within its bounding box, grown
    by ``margin`` cells, from prefix sums.  Ranks come from sorted ranges.  ``cells`` has blocked, floor, accessible.
    """
    names = dimension.where(F.col("fixation") != "Fixed")
    labelled = removable_objects(cells, labels, dimension)
    boxes = labelled.groupBy("label", "component").agg(
        F.count(F.lit(1)).alias("cells"), F.min("gy").alias("y0"), F.max("gy").alias("y1"), F.min("gx").alias("x0"), F.max("gx").alias("x1")
    ).where(F.col("cells") >= math.ceil(least_area / resolution**2))
    grown = boxes.select("*", F.col("component").alias("id"))
    lost = cells.withColumn("lost", (F.col("floor") & ~F.col("accessible")).cast("long"))
    size = lost.agg(F.max("gy").alias("hy"), F.max("gx").alias("hx"))
    grown = grown.join(F.broadcast(size)).select(
        "id", F.greatest(F.col("y0") - margin, F.lit(0)).alias("y0"), F.greatest(F.col("x0") - margin, F.lit(0)).alias("x0"),
        F.least(F.col("y1") + margin, F.col("hy")).alias("y1"), F.least(F.col("x1") + margin, F.col("hx")).alias("x1"),
    )
    unlock = G.rectangle_sums(G.prefix_sums(lost, "lost"), grown)
    found = boxes.join(unlock.withColumnRenamed("id", "component"), "component").where("total > 0").join(F.broadcast(names), "label")
    best = F.struct("priority", -F.col("total"), -F.col("cells"), "component")
    return numbered(saved(found.withColumn("__best", best)), "__best", "rank").select(
        "rank", "label", "name", "fixation", "cells", (F.col("cells") * resolution**2).alias("area"), (F.col("total") * resolution**2).alias("unlock_area"), "y0", "x0", "y1", "x1"
    )
