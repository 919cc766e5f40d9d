"""Ramps: line fits, principal axes, profiles and greedy segments."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfloor.functions.shared import saved
from wayfloor.operators import components as C
from wayfloor.operators.greedy import apart, nearest_choice
from wayfloor.operators.percentiles import by_group
from wayfloor.operators.points import cell
from wayfloor.streaming.replay import numbered


def line_fit(groups: DataFrame, keys: list[str], x: str = "x", z: str = "z", flat_r2: float = 1.0) -> DataFrame:
    """Least squares per group: slope, intercept, r2; a flat profile has ``flat_r2``."""
    fit = groups.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.regr_slope(z, x).alias("slope"), F.regr_intercept(z, x).alias("intercept"), F.regr_r2(z, x).alias("r2"), F.var_pop(z).alias("__v")
    )
    return fit.withColumn("r2", F.when(F.col("__v") < 1e-12, F.lit(flat_r2)).otherwise(F.col("r2"))).drop("__v")


def principal_extent(cells: DataFrame, keys: list[str], size: float) -> DataFrame:
    """Extent of each group of cells along its principal axis and across it, from the closed form of a 2 by 2 matrix; a cell at least."""
    m = cells.groupBy(*keys).agg(
        F.avg("gx").alias("mx"), F.avg("gy").alias("my"), F.coalesce(F.var_pop("gx"), F.lit(0.0)).alias("a"), F.coalesce(F.var_pop("gy"), F.lit(0.0)).alias("c"), F.coalesce(F.covar_pop("gx", "gy"), F.lit(0.0)).alias("b")
    )
    m = m.withColumn("theta", 0.5 * F.atan2(2 * F.col("b"), F.col("a") - F.col("c")))
    turned = cells.join(m.select(*keys, "theta"), keys)
    along = F.col("gx") * F.cos("theta") + F.col("gy") * F.sin("theta")
    across = -F.col("gx") * F.sin("theta") + F.col("gy") * F.cos("theta")
    wide = lambda v: F.greatest((F.max(v) - F.min(v)) * size, F.lit(float(size)))
    return turned.groupBy(*keys).agg(F.count(F.lit(1)).alias("cells"), wide(along).alias("length"), wide(across).alias("width"))


def direction_consistency(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Length of the mean unit gradient; 0 with fewer than three steep enough cells."""
    size = F.sqrt(F.col("dzdx") ** 2 + F.col("dzdy") ** 2)
    unit = cells.withColumn("__m", size).where(F.col("__m") > 1e-8)
    g = unit.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("dzdx") / F.col("__m")).alias("ux"), F.avg(F.col("dzdy") / F.col("__m")).alias("uy"))
    return g.select(*keys, F.when(F.col("n") >= 3, F.sqrt(F.col("ux") ** 2 + F.col("uy") ** 2)).otherwise(0.0).alias("consistency"))


def slope_candidates(cells: DataFrame, size: float, least_slope: float = 5.0, least_area: float = 1.0) -> DataFrame:
    """Components of sloping cells that are large enough: ``(component, gy, gx, z, slope, dzdx, dzdy)``.  A slope past 60 degrees is a wall."""
    steep = cells.where((F.col("slope") >= least_slope) & (F.col("slope") <= 60))
    labelled = C.drop_small(C.components(steep.select("gy", "gx")), max(3, int(least_area / size**2)))
    return labelled.join(steep, ["gy", "gx"])


def slope_ramps(cells: DataFrame, size: float, least_length: float = 1.0, least_width: float = 0.5, least_area: float = 1.0, least_rise: float = 0.15) -> DataFrame:
    """Ramps from a grid of slopes: size, direction consistency and rise decide; angle is the median slope."""
    c = saved(slope_candidates(saved(cells), size, least_area=least_area))
    stats = c.groupBy("component").agg(F.median("slope").alias("angle"), (F.max("z") - F.min("z")).alias("rise"))
    found = principal_extent(c, ["component"], size).join(direction_consistency(c, ["component"]), "component").join(stats, "component")
    found = found.withColumn("area", F.col("cells") * size * size)
    even = F.col("consistency") >= F.when(F.col("area") > 5, 0.4).otherwise(0.6)
    return found.where((F.col("length") >= least_length) & (F.col("width") >= least_width) & (F.col("area") >= least_area) & even & (F.col("rise") >= least_rise))


def assessed(transitions: DataFrame, max_slope: float, max_step: float) -> DataFrame:
    """``(kind, angle, height)`` with ``traversable``: ramps by angle, steps by height, anything else is not."""
    ok = F.when(F.col("kind") == "ramp", F.col("angle") <= max_slope).when(F.col("kind") == "step", F.col("height") <= max_step).otherwise(False)
    return transitions.withColumn("traversable", ok)


def profiles(points: DataFrame, strip: float = 0.5, step: float = 0.20, least_strip: int = 10, least_bin: int = 3, least_profile: int = 5, percentile: float = 0.10) -> DataFrame:
    """Height profiles along x in strips of y: ``(strip, bin, x, z)``; bins start at each strip's first point."""
    return _profiles(points.select("x", "z", cell(F.col("y"), strip).alias("strip")), step, least_strip, least_bin, least_profile, percentile)


def _profiles(keyed: DataFrame, step: float, least_strip: int, least_bin: int, least_profile: int, percentile: float) -> DataFrame:
    starts = keyed.groupBy("strip").agg(F.min("x").alias("x0"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_strip).select("strip", "x0")
    # A row a strip: as few as the map is wide.
    bins = keyed.join(F.broadcast(starts), "strip").withColumn("bin", F.floor((F.col("x") - F.col("x0")) / F.lit(step)))
    z = by_group(bins, ["strip", "x0", "bin"], "z", percentile).where(F.col("n") >= least_bin)
    z = z.select("strip", "bin", (F.col("x0") + (F.col("bin") + 0.5) * step).alias("x"), "z")
    return z.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy("strip"))).where(F.col("__n") >= least_profile).drop("__n")


def greedy_segments(rows: DataFrame, least_points: int = 3, least_r2: float = 0.85, flat: float = 0.05) -> DataFrame:
    """``(strip, x, z)`` -> line segments of each profile: one grows while the fit stays good, the next begins at its last point.

    The rule is sequential along a profile, so a profile is one grouped task;
    profiles are short, bounded by the map's width.
    """

    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        pdf = pdf.sort_values("x", kind="stable")
        x, z = pdf["x"].to_numpy(), pdf["z"].to_numpy()

        def fit(a, b):
            u, v = x[a:b], z[a:b]
            sxx, szz = ((u - u.mean()) ** 2).sum(), ((v - v.mean()) ** 2).sum()
            sxz = ((u - u.mean()) * (v - v.mean())).sum()
            slope = sxz / sxx if sxx > 0 else 0.0
            return slope, 1.0 if szz < 1e-12 else (sxz * sxz / (sxx * szz) if sxx > 0 else 0.0)

        out, at, n = [], 0, len(x)
        while at + least_points <= n:
            end = at + least_points
            slope, r2 = fit(at, end)
            while end < n:
                s, r = fit(at, end + 1)
                if r < least_r2:
                    break
                slope, r2, end = s, r, end + 1
            out.append((int(pdf["strip"].iloc[0]), len(out), float(x[at]), float(x[end - 1]), float(z[at]), float(z[end - 1]), float(slope), float(r2), bool(abs(np.float64(slope)) < flat)))
            at = end - 1
        return pd.DataFrame(out, columns=["strip", "segment", "x0", "x1", "z0", "z1", "slope", "r2", "is_flat"])

    return rows.select("strip", "x", "z").groupBy("strip").applyInPandas(split, "strip long, segment int, x0 double, x1 double, z0 double, z1 double, slope double, r2 double, is_flat boolean")


def profile_ramps(segments: DataFrame, least_slope: float = 4.0, least_length: float = 1.0, least_rise: float = 0.05) -> DataFrame:
    """Segments steep, long and high enough that have a flat neighbour."""
    order = Window.partitionBy("strip").orderBy("segment")
    beside = F.coalesce(F.lag("is_flat").over(order), F.lit(False)) | F.coalesce(F.lead("is_flat").over(order), F.lit(False))
    s = segments.withColumns({"beside": beside, "angle": F.degrees(F.atan(F.abs("slope"))), "length": F.col("x1") - F.col("x0"), "rise": F.abs(F.col("z1") - F.col("z0"))})
    return s.where(~F.col("is_flat") & F.col("beside") & (F.col("angle") >= least_slope) & (F.col("length") >= least_length) & (F.col("rise") >= least_rise))


#: Headings of the cross-sections, in degrees, and the number of strips a heading may have.
DIRECTIONS = (0, 45, 90, 135)
_STRIPS = 1 << 32


def section_candidates(points: DataFrame, strip: float = 0.5, step: float = 0.20, least_slope: float = 4.0, least_length: float = 1.0) -> DataFrame:
    """Ramp segments of the profiles along every heading, in one job: ``(heading, strip_y, x0, x1, angle, rise, length, r2, wx0, wy0, wx1, wy1)``.

    ``x0`` and ``x1`` are places along the heading, the w columns the ends in the frame of the points.
    """
    rows = [(i, math.cos(math.radians(d)), math.sin(math.radians(d))) for i, d in enumerate(DIRECTIONS)]
    turns = F.broadcast(points.sparkSession.createDataFrame(rows, "i int, c double, s double"))
    turned = points.join(turns).select("i", "z", (F.col("x") * F.col("c") + F.col("y") * F.col("s")).alias("x"), (F.col("y") * F.col("c") - F.col("x") * F.col("s")).alias("y"))
    keyed = turned.select("x", "z", (F.col("i") * _STRIPS + cell(F.col("y"), strip) + _STRIPS // 2).alias("strip"))
    found = profile_ramps(greedy_segments(_profiles(keyed, step, 10, 3, 5, 0.10)), least_slope, least_length)
    i = F.floor(F.col("strip") / _STRIPS).cast("int")
    y = (F.col("strip") - i * _STRIPS - _STRIPS // 2 + 0.5) * strip
    found = found.withColumns({"i": i, "strip_y": y}).join(turns, "i")
    world = lambda x: ((F.col(x) * F.col("c") - F.col("strip_y") * F.col("s")).alias(f"w{x}"), (F.col(x) * F.col("s") + F.col("strip_y") * F.col("c")).alias(f"wy{x[1]}"))
    out = found.select("i", "strip_y", "x0", "x1", "angle", "rise", "length", "r2", *world("x0"), *world("x1"))
    return out.withColumn("heading", F.element_at(F.array(*(F.lit(d) for d in DIRECTIONS)), F.col("i") + 1)).drop("i")


def radius_clusters(candidates: DataFrame, radius: float) -> DataFrame:
    """Adds ``cluster``: by heading, strip and place, the first free candidate takes all free ones nearer than the radius to it.

    The rule is not transitive.  The first of every cluster are a greedy choice
    of candidates that are apart; each of the others belongs to the first of
    those near it, whose number names the cluster.
    """
    middle = lambda a, b: (F.col(a) + F.col(b)) / 2
    order = F.struct("heading", "strip_y", "x0", "x1", "wx0", "wy0", "wx1", "wy1")
    placed = saved(numbered(candidates.withColumn("__order", order), "__order", "__id").withColumn("__id", F.col("__id") - 1).drop("__order"))
    places = placed.select(F.col("__id").alias("id"), middle("wy0", "wy1").alias("y"), middle("wx0", "wx1").alias("x"), F.col("__id").alias("rank"))
    own = nearest_choice(places, saved(apart(places, radius)), radius).select(F.col("id").alias("__id"), F.col("choice").cast("long").alias("cluster"))
    return placed.join(own, "__id").drop("__id")


def section_ramps(points: DataFrame, max_slope: float = 35.0, radius: float = 5.0, strip: float = 0.5, least_length: float = 1.0, least_rise: float = 0.10, least_width: float = 0.8) -> DataFrame:
    """Ramps from cross-sections along four headings, the steepest first: clusters of three candidates or more, the best fit for each."""
    c = radius_clusters(section_candidates(points, strip, least_length=least_length), radius)
    best = F.max_by(F.struct("wx0", "wy0", "wx1", "wy1", "length", "rise", "r2", "heading"), F.struct("r2", -F.col("heading"), -F.col("strip_y"), -F.col("x0"))).alias("b")
    by = c.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), best, F.greatest(F.max("strip_y") - F.min("strip_y"), F.lit(strip)).alias("width"), F.avg("angle").alias("angle"))
    by = by.where((F.col("n") >= 3) & (F.col("b.length") >= least_length) & (F.col("b.rise") >= least_rise) & (F.col("width") >= least_width))
    return by.select("cluster", "n", "angle", "width", "b.*", (F.col("angle") <= max_slope).alias("traversable"))


def refined_angles(ramps: DataFrame, points: DataFrame, margin: float = 2.0, strip: float = 0.5, step: float = 0.15, least_points: int = 20, least_bins: int = 4, least_r2: float = 0.5) -> DataFrame:
    """``ramps(ramp, wx0, wy0, wx1, wy1, angle)`` with ``refined``: the median angle of the lines through strips along the ramp.

    The points within ``margin`` of the ramp's box are cut into strips beside
    its axis and bins along it, both from the first point on; bins take a low
    percentile of three heights or more.  Strips of fewer than ten points, few
    bins or a poor fit do not count; without any the angle stays.
    """
    box = {"bx0": F.least("wx0", "wx1"), "bx1": F.greatest("wx0", "wx1"), "by0": F.least("wy0", "wy1"), "by1": F.greatest("wy0", "wy1"), "long": F.sqrt((F.col("wx1") - F.col("wx0")) ** 2 + (F.col("wy1") - F.col("wy0")) ** 2)}
    r = ramps.select("ramp", "wx0", "wy0", "wx1", "wy1").withColumns(box).where(F.col("long") >= 0.1)  # few rows: a ramp each
    near = points.join(F.broadcast(r), F.col("x").between(F.col("bx0") - margin, F.col("bx1") + margin) & F.col("y").between(F.col("by0") - margin, F.col("by1") + margin))
    ux, uy = (F.col("wx1") - F.col("wx0")) / F.col("long"), (F.col("wy1") - F.col("wy0")) / F.col("long")
    dx, dy = F.col("x") - (F.col("wx0") + F.col("wx1")) / 2, F.col("y") - (F.col("wy0") + F.col("wy1")) / 2
    at = saved(near.select("ramp", "z", (dx * ux + dy * uy).alias("t"), (dy * ux - dx * uy).alias("u")))
    sides = at.groupBy("ramp").agg(F.count(F.lit(1)).alias("n"), F.min("u").alias("u0"), F.greatest(F.lit(1), F.floor((F.max("u") - F.min("u")) / strip)).alias("strips")).where(F.col("n") >= least_points)
    cut = at.join(F.broadcast(sides.drop("n")), "ramp").withColumn("strip", F.floor((F.col("u") - F.col("u0")) / strip)).where(F.col("strip") < F.col("strips"))
    lines = cut.groupBy("ramp", "strip").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("t0"), F.greatest(F.lit(1), F.floor((F.max("t") - F.min("t")) / step)).alias("bins")).where("n >= 10")
    bins = cut.join(lines.drop("n"), ["ramp", "strip"]).withColumn("bin", F.floor((F.col("t") - F.col("t0")) / step)).where(F.col("bin") < F.col("bins"))
    rows = by_group(bins, ["ramp", "strip", "t0", "bin"], "z", 0.10).where("n >= 3").withColumn("x", F.col("t0") + (F.col("bin") + 0.5) * step)
    fits = line_fit(rows, ["ramp", "strip"], flat_r2=0.0).where((F.col("n") >= least_bins) & (F.col("r2") >= least_r2))
    angle = fits.groupBy("ramp").agg(F.percentile(F.degrees(F.atan(F.abs("slope"))), F.lit(0.5)).alias("refined"))
    return ramps.join(angle, "ramp", "left").withColumn("refined", F.coalesce("refined", "angle"))
