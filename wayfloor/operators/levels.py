"""Floor levels from the histogram of heights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfloor.functions.shared import saved
from wayfloor.operators.percentiles import by_group

BIN, PROMINENCE, SEPARATION, CEILING = 0.10, 0.15, 1.8, 3.0


def histogram(points: DataFrame, width: float = BIN, ends: DataFrame | None = None) -> DataFrame:
    """``(bin, n, low, size)``: equal bins over the whole range, 8 at least, the last one closed; empty bins are rows too.

    ``ends`` is the row of the least and the greatest height, if it is known.
    """
    r = height_range(points) if ends is None else ends
    r = r.withColumn("bins", F.greatest(F.lit(8).cast("long"), F.ceil((F.col("z1") - F.col("z0")) / F.lit(width)))).withColumn("size", (F.col("z1") - F.col("z0")) / F.col("bins"))
    index = F.least(F.floor((F.col("z") - F.col("z0")) / F.col("size")), F.col("bins") - 1)
    n = points.select("z").join(F.broadcast(r)).groupBy(index.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    all_bins = r.select("z0", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bins") - 1)).alias("bin"))
    return all_bins.join(n, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), (F.col("z0") + F.col("bin") * F.col("size")).alias("low"), "size")


def height_range(points: DataFrame) -> DataFrame:
    """One row ``(z0, z1)`` of the least and the greatest height, written."""
    return saved(points.agg(F.min("z").alias("z0"), F.max("z").alias("z1")), "ends")


def smoothed(bins: DataFrame) -> DataFrame:
    """Adds ``s``: the mean of three neighbours, outside counting as 0.  A histogram is short, so one window is enough."""
    return bins.withColumn("s", F.sum("n").over(Window.orderBy("bin").rowsBetween(-1, 1)) / 3.0)


def peaks(bins: DataFrame, prominence: float = PROMINENCE) -> DataFrame:
    """Bins at least as high as both neighbours, higher than one, and high enough: ``(bin, s, anchor)``."""
    order = Window.orderBy("bin")
    near = bins.withColumns({"l": F.coalesce(F.lag("s").over(order), F.lit(0.0)), "r": F.coalesce(F.lead("s").over(order), F.lit(0.0)), "top": F.max("s").over(Window.partitionBy(F.lit(1)))})
    tall = (F.col("s") >= F.col("l")) & (F.col("s") >= F.col("r")) & ((F.col("s") > F.col("l")) | (F.col("s") > F.col("r"))) & (F.col("s") >= prominence * F.col("top"))
    return near.where(tall).select("bin", "s", (F.col("low") + F.col("size") / 2).alias("anchor"))


def merged(found: DataFrame, separation: float = SEPARATION) -> DataFrame:
    """One after the other, peaks nearer than ``separation`` to the last kept are merged with it, the taller staying."""
    ordered = found.agg(F.array_sort(F.collect_list(F.struct("anchor", "s"))).alias("p"))
    none = F.array().cast("array<struct<anchor:double,s:double>>")

    def step(kept, p):
        last = F.element_at(kept, -1)
        near = (F.size(kept) > 0) & (p["anchor"] - last["anchor"] < separation)
        return F.when(~near, F.concat(kept, F.array(p))).when(p["s"] > last["s"], F.concat(F.slice(kept, F.lit(1), F.size(kept) - 1), F.array(p))).otherwise(kept)

    return ordered.select(F.explode(F.aggregate("p", none, step)).alias("p")).select("p.*")


def levels(points: DataFrame) -> DataFrame:
    """``(level, anchor, z_low, z_high, n)``: slabs between the peaks; the top one ends at the ceiling or the last point."""
    ends = height_range(points)
    kept = merged(peaks(smoothed(histogram(points, ends=ends))))
    order = Window.orderBy("anchor")
    slabs = kept.select(
        (F.row_number().over(order) - 1).alias("level"), "anchor", F.lag("anchor").over(order).alias("below"), F.lead("anchor").over(order).alias("above")
    ).join(F.broadcast(ends))
    slabs = slabs.select(
        "level", "anchor", F.coalesce((F.col("anchor") + F.col("below")) / 2, "z0").alias("z_low"), F.coalesce((F.col("anchor") + F.col("above")) / 2, F.least("z1", F.col("anchor") + CEILING)).alias("z_high")
    )
    inside = points.select("z").join(F.broadcast(slabs), F.col("z").between(F.col("z_low"), F.col("z_high")))
    return inside.groupBy("level", "anchor", "z_low", "z_high").agg(F.count(F.lit(1)).alias("n"))


def level_floors(points: DataFrame, slabs: DataFrame) -> DataFrame:
    """``(level, z_low, z_high, floor)``: slabs with the 5th percentile of their heights, null without any, a row a level, written."""
    inside = points.select("z").join(F.broadcast(slabs), F.col("z").between(F.col("z_low"), F.col("z_high"))).select("level", "z")
    floor = by_group(inside, ["level"], "z", 0.05).select("level", F.col("z").alias("floor"))
    return saved(slabs.join(floor, "level", "left").select("level", "z_low", "z_high", "floor"), "floors")


def level_maps(points: DataFrame, slabs: DataFrame, resolution: float = 0.05, padding: float = 0.5, least: int = 1, meta: DataFrame | None = None, floors: DataFrame | None = None) -> DataFrame:
    """``(level, gy, gx, n, occupied)``: the obstacle map of every level's slab, all on the map of all points, in one job.

    The band of a level is over its own floor, the 5th percentile of its heights.
    ``meta`` is the map's geometry and ``floors`` of ``level_floors``, if they are known.
    """
    from wayfloor.operators import grid as G

    floors = level_floors(points, saved(slabs.select("level", "z_low", "z_high"))) if floors is None else floors
    slabs = floors.select("level")
    meta = saved(G.bounds(points, resolution, padding)) if meta is None else meta
    inside = points.select("x", "y", "z").join(F.broadcast(floors), F.col("z").between(F.col("z_low"), F.col("z_high")))
    band = inside.where(F.col("z").between(F.col("floor") + 0.05, F.col("floor") + 1.0)).select("level", "x", "y")
    counts = G.binned(band, meta, resolution).groupBy("level", "gy", "gx").agg(F.count(F.lit(1)).alias("n"))
    edge = (F.col("gy") == 0) | (F.col("gx") == 0) | (F.col("gy") == F.col("height") - 1) | (F.col("gx") == F.col("width") - 1)
    grid = G.scaffold(meta).join(F.broadcast(slabs)).join(counts, ["level", "gy", "gx"], "left")
    return grid.select("level", "gy", "gx", F.coalesce("n", F.lit(0)).alias("n"), (edge | (F.coalesce("n", F.lit(0)) >= max(1, least))).alias("occupied"))
