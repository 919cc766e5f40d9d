"""How much wall a tool reaches: wall voxels, horizontal rays, painted patches, wall segments.

Rays are horizontal, so the voxel sequence of a ray has a closed form: the k-th
crossing of an x plane and of a y plane are at known distances.  All crossings
are rows; a join with the sparse voxels and a minimum give each ray's first hit.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfloor.functions.shared import saved
from wayfloor.operators import components as C
from wayfloor.operators.percentiles import percentile_row
from wayfloor.operators.points import cell
from wayfloor.streaming.replay import numbered


def corner(points: DataFrame, size: float) -> DataFrame:
    """One row ``(ox, oy, oz, floor)``: the corner of the voxels, one below the least coordinates, and the height of the floor, the 5th percentile."""
    least = [F.min(c).alias(f"{c}0") for c in "xyz"]
    return corner_of(percentile_row(points, "z", [0.05], also=least).select("*", F.col("p")[0].alias("floor")), size)


def corner_of(least: DataFrame, size: float) -> DataFrame:
    """The same from a row of least coordinates and the floor."""
    return least.select(*((F.col(f"{c}0") - size).alias(f"o{c}") for c in "xyz"), "floor")


def wall_voxels(points: DataFrame, size: float = 0.05, majority: float = 0.60, low: float = 0.40, high: float = 2.00, wall_label: int = 1, at: DataFrame | None = None) -> DataFrame:
    """``(vx, vy, vz, n, wall, in_band)``: occupied voxels, walls by the share of wall points; the band is over the floor (5th percentile).

    ``at`` is the row of ``corner``, if it is known.
    """
    o = corner(points, size) if at is None else at
    keyed = points.join(F.broadcast(o)).select(*(cell(F.col(c), size, F.col(f"o{c}")).alias(f"v{c}") for c in "xyz"), "label", "oz", "floor")
    v = keyed.groupBy("vx", "vy", "vz").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == wall_label).alias("n_wall"), F.first("oz").alias("oz"), F.first("floor").alias("floor"))
    z = F.col("oz") + (F.col("vz") + 0.5) * size
    wall = F.col("n_wall") / F.col("n") >= majority
    return v.select("vx", "vy", "vz", "n", wall.alias("wall"), (wall & z.between(F.col("floor") + low, F.col("floor") + high)).alias("in_band"))


def tool_origins(reached: DataFrame, meta: DataFrame, points: DataFrame, resolution: float, size: float, stride: int = 3, low: float = 0.40, high: float = 2.00, step: float = 0.20, at: DataFrame | None = None) -> DataFrame:
    """``(oid, px, py, vz)`` in voxel units: every ``stride``-th reached cell of a map in both directions, at every tool height.

    ``reached(gy, gx)`` are cells of the map that ``meta(ox, oy)`` places; heights are over the floor of the points.
    ``at`` is the row of ``corner``, if it is known.
    """
    o = (corner(points, size) if at is None else at).select(*(F.col(f"o{c}").alias(f"v{c}0") for c in "xyz"), "floor")
    at = reached.where((F.col("gy") % stride == 0) & (F.col("gx") % stride == 0)).select("gy", "gx")
    at = at.join(F.broadcast(meta.select("ox", "oy"))).join(F.broadcast(o))
    levels = F.sequence(F.lit(0), F.lit(round((high - low) / step)))
    at = at.select("*", F.explode(levels).alias("h"))
    centre = lambda c, o, v: (F.col(o) + (F.col(c) + 0.5) * resolution - F.col(v)) / F.lit(size)
    z = F.col("floor") + low + F.col("h") * step
    number = (F.col("gy") * (1 << 24) + F.col("gx")) * 64 + F.col("h")
    return at.select(number.alias("oid"), centre("gx", "ox", "vx0").alias("px"), centre("gy", "oy", "vy0").alias("py"), F.floor((z - F.col("vz0")) / F.lit(size)).cast("long").alias("vz"))


def capped_origins(origins: DataFrame, most: int = 60_000) -> DataFrame:
    """``origins(oid, ...)`` thinned evenly to ``most`` of them, in the order of their numbers; all of them where they are no more.

    The i-th kept is the one at place floor(i * n / most), as a stride that need not be whole would take it.
    For a quick look at a wide floor; no query thins its origins.
    """
    n = origins.count()
    if n <= most:
        return origins
    placed = numbered(origins, "oid", "__place")
    i = F.col("__place") - 1
    # A place is taken if some i * n / most falls on it: the number of these up to it grows there.
    upto = lambda k: F.expr(f"CAST((CAST({k} AS DECIMAL(38, 0)) * {most} + {n - 1}) DIV {n} AS LONG)")
    return placed.withColumn("__at", i).where(upto("__at + 1") > upto("__at")).drop("__place", "__at")


def wall_colours(points: DataFrame, cells: DataFrame, focused: DataFrame, selected: DataFrame, wall_label: int = 1, size: float = 0.20) -> DataFrame:
    """Points with r, g, b: walls orange, those of the focused segments cyan, of the selected ones pink, the rest grey.

    ``cells(gy, gx, component)`` are the cells of wall segments, ``focused`` and ``selected`` hold components.
    """
    # The colours.
    grey, orange, cyan, pink = (140, 140, 140), (255, 160, 0), (80, 220, 255), (255, 90, 180)
    kind = cells.join(focused.select("component").distinct().withColumn("__f", F.lit(True)), "component", "left").join(selected.select("component").distinct().withColumn("__s", F.lit(True)), "component", "left")
    keyed = points.withColumns({"__gy": cell(F.col("y"), size), "__gx": cell(F.col("x"), size)})
    at = keyed.join(kind.select(F.col("gy").alias("__gy"), F.col("gx").alias("__gx"), "__f", "__s"), ["__gy", "__gx"], "left")
    wall = F.col("label") == wall_label
    colour = lambda i: F.when(wall & F.col("__f"), cyan[i]).when(wall & F.col("__s"), pink[i]).when(wall, orange[i]).otherwise(grey[i])
    return at.select(*points.columns, *(colour(i).alias(c) for i, c in enumerate("rgb")))


def first_hits(origins: DataFrame, voxels: DataFrame, size: float, reach: float = 1.0, step_degrees: int = 10) -> DataFrame:
    """``origins(oid, px, py, vz)`` in voxel units -> ``(oid, k, hx, hy, vz, in_band)``: the first occupied voxel of each ray.

    Positions are taken from the grid's corner; x crossings come before y crossings at equal distance.
    """
    n = math.ceil(reach / size) + 1
    spark = origins.sparkSession
    # Only origins with a voxel of their height in the nine tiles around them can meet one.
    near = F.sequence(F.lit(-1), F.lit(1))
    tiles = voxels.select("vz", F.floor(F.col("vy") / n).alias("ty"), F.floor(F.col("vx") / n).alias("tx")).distinct()
    tiles = tiles.select("vz", "ty", "tx", F.explode(near).alias("a")).select("*", F.explode(near).alias("b")).select("vz", (F.col("ty") + F.col("a")).alias("ty"), (F.col("tx") + F.col("b")).alias("tx")).distinct()
    keyed = origins.withColumns({"ty": F.floor(F.floor("py") / n), "tx": F.floor(F.floor("px") / n)})
    origins = keyed.join(tiles, ["vz", "ty", "tx"], "left_semi").select("oid", "px", "py", "vz")
    rays = [(k, math.cos(math.radians(k * step_degrees)), math.sin(math.radians(k * step_degrees))) for k in range(360 // step_degrees)]
    fan = origins.join(F.broadcast(spark.createDataFrame(rays, "k int, dx double, dy double")))
    i = F.explode(F.sequence(F.lit(0), F.lit(n)))

    def plane(p, d):
        """Distance to the i-th plane along an axis, infinite for a ray that runs along it."""
        first = F.when(F.col(d) > 0, F.floor(p) + 1 - F.col(p)).otherwise(F.col(p) - F.floor(p))
        return F.when(F.abs(d) > 1e-12, (first + F.col("i")) / F.abs(d)).otherwise(F.lit(float("inf")))

    def passed(p, d, t, before):
        """How many planes of an axis lie before t (or at it)."""
        first = F.when(F.col(d) > 0, F.floor(p) + 1 - F.col(p)).otherwise(F.col(p) - F.floor(p))
        m = (t * F.abs(d) - first)
        count = F.floor(m) + 1 if not before else F.ceil(m)
        return F.when((F.abs(d) > 1e-12) & (count > 0), count).otherwise(F.lit(0)).cast("long")

    rows = fan.select("*", i.alias("i"))
    sx, sy = F.when(F.col("dx") > 0, 1).otherwise(-1), F.when(F.col("dy") > 0, 1).otherwise(-1)
    x0, y0 = F.floor("px").cast("long"), F.floor("py").cast("long")
    tx, ty = plane("px", "dx"), plane("py", "dy")
    keys = ["oid", "k", "vz"]
    start = fan.select(*keys, F.lit(0.0).alias("t"), F.lit(0).alias("order"), x0.alias("vx"), y0.alias("vy"))
    by_x = rows.select(*keys, tx.alias("t"), F.lit(1).alias("order"), (x0 + sx * (F.col("i") + 1)).alias("vx"), (y0 + sy * passed("py", "dy", tx, True)).alias("vy"))
    by_y = rows.select(*keys, ty.alias("t"), F.lit(2).alias("order"), (x0 + sx * passed("px", "dx", ty, False)).alias("vx"), (y0 + sy * (F.col("i") + 1)).alias("vy"))
    path = start.unionByName(by_x).unionByName(by_y).where(F.col("t") * size <= reach + 1e-6)
    met = path.join(voxels.select("vx", "vy", "vz", "in_band"), ["vx", "vy", "vz"])
    first = met.groupBy("oid", "k", "vz").agg(F.min(F.struct("t", "order", F.col("vx").alias("hx"), F.col("vy").alias("hy"), "in_band")).alias("h"))
    return first.select("oid", "k", "vz", "h.hx", "h.hy", "h.in_band")


def painted(hits: DataFrame, voxels: DataFrame, size: float, width: float = 0.25, span: float = 0.30) -> DataFrame:
    """Wall-band voxels within the tool's box around a hit on the band."""
    r, rz = math.ceil(0.5 * width / size), math.ceil(0.5 * span / size)
    spread = hits.where("in_band").select(F.col("hx").alias("vx"), F.col("hy").alias("vy"), "vz").distinct()
    for c, reach in (("vx", r), ("vy", r), ("vz", rz)):
        spread = spread.withColumn(c, F.explode(F.sequence(F.col(c) - reach, F.col(c) + reach))).distinct()
    return voxels.where("in_band").select("vx", "vy", "vz").join(spread, ["vx", "vy", "vz"], "left_semi")


def continuity(cells: DataFrame) -> DataFrame:
    """Share of the largest 6-connected component of painted voxels."""
    labelled = C.components(cells.select("vz", F.col("vy").alias("gy"), F.col("vx").alias("gx")), space=True)
    n = C.sizes(labelled)
    return n.agg(F.count(F.lit(1)).alias("components"), F.max("n").alias("largest"), F.sum("n").alias("painted"))


def wall_segments(points: DataFrame, size: float = 0.20, least_area: float = 0.5, wall_label: int = 1) -> DataFrame:
    """Components of wall cells with their area, centroid, bounds and points, the largest first."""
    walls = points.where(F.col("label") == wall_label).select("x", "y", "z", cell(F.col("y"), size).alias("gy"), cell(F.col("x"), size).alias("gx"))
    labelled = saved(C.components(walls.select("gy", "gx").distinct()))
    by = walls.join(labelled, ["gy", "gx"]).groupBy("component").agg(
        F.count_distinct("gy", "gx").alias("cells"), F.count(F.lit(1)).alias("points"), F.avg("x").alias("cx"), F.avg("y").alias("cy"),
        F.min("z").alias("z_min"), F.max("z").alias("z_max"), F.min("x").alias("x_min"), F.max("x").alias("x_max"), F.min("y").alias("y_min"), F.max("y").alias("y_max"),
    )
    return by.withColumn("area", F.col("cells") * size * size).where(F.col("area") >= least_area)
