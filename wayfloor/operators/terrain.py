"""Terrain masks from a grid of heights, and maps derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfloor.functions.shared import saved
from wayfloor.operators import components as C
from wayfloor.operators import grid as G


def _kept(cells: DataFrame, flag: str, least: int, by: str | None = None) -> DataFrame:
    """``flag`` without components under ``least`` cells."""
    keys = [*([by] if by else []), "gy", "gx"]
    kept = C.drop_small(C.components(cells.where(flag).select(*keys), by=by), least).select(*keys).withColumn("__k", F.lit(True))
    return cells.join(kept, keys, "left").withColumn(flag, F.coalesce("__k", F.lit(False))).drop("__k")


def masks(heights: DataFrame, meta: DataFrame, size: float, max_slope: float = 35.0, max_step: float = 0.25, least: int = 20, rounds: int = 4, close: int = 3, by: str | None = None) -> DataFrame:
    """Dense ``(gy, gx, z)`` -> ``(gy, gx, known, traversable)``.

    Known cells have a height; traversable ones are known, not steep, without a
    step, in components of ``least`` cells, with small gaps closed.  ``by`` names
    a column (of levels) whose values are maps of their own, all in the same jobs.
    """
    keys = (by,) if by else ()
    at = [*keys, "gy", "gx"]
    smooth = saved(G.gaussian(G.median3(heights, by=keys), 2.0, by=keys))
    shape = G.gradients(G.fill_holes(smooth, rounds, meta, by=keys), size, by=keys).select(*at, "slope")
    step = G.step_height(smooth, by=keys).select(*at, "step")
    cells = heights.select(*at, F.col("z").isNotNull().alias("known")).join(shape, at).join(step, at)
    cells = cells.select(*at, "known", (F.col("known") & F.coalesce(F.col("slope") <= max_slope, F.lit(False)) & (F.col("step") <= max_step)).alias("traversable"))
    cells = _kept(saved(cells), "known", least, by)
    cells = _kept(saved(cells.withColumn("traversable", F.col("traversable") & F.col("known"))), "traversable", least, by)
    return G.close(saved(cells), "traversable", close, keys).withColumn("traversable", F.col("traversable") & F.col("known"))


def map_pixels(cells: DataFrame, flag: str) -> DataFrame:
    """Free where the flag holds, occupied elsewhere and along the border."""
    size = cells.agg(F.max("gy").alias("hy"), F.max("gx").alias("hx"))
    edge = (F.col("gy") == 0) | (F.col("gx") == 0) | (F.col("gy") == F.col("hy")) | (F.col("gx") == F.col("hx"))
    return cells.join(F.broadcast(size)).select("gy", "gx", F.when(F.col(flag) & ~edge, 254).otherwise(0).alias("pixel"))


def blocked_by_ramps(cells: DataFrame, ramps: DataFrame, coarse: float, resolution: float) -> DataFrame:
    """``cells(gy, gx, blocked)`` with the centre pixel of every cell of a failed ramp blocked: ``ramps(row, col, traversable)``."""
    centre = lambda c: F.floor((F.col(c) + 0.5) * coarse / F.lit(resolution)).cast("long")
    failed = ramps.where("NOT traversable").select(centre("row").alias("gy"), centre("col").alias("gx")).distinct().withColumn("__b", F.lit(True))
    return cells.join(failed, ["gy", "gx"], "left").withColumn("blocked", F.col("blocked") | F.coalesce("__b", F.lit(False))).drop("__b")
