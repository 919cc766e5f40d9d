"""Raster operators on cell tables ``(gy, gx, ...)``: scaffolds, stencils, morphology, pooling, prefix sums.

A stencil is a join of the cells with a small offsets table on shifted integer
keys, or, where the window is one row or column of a dense grid, a window
function.  Missing cells are absent rows; unknown values are nulls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfloor.operators.percentiles import by_group
from wayfloor.operators.points import cell

CROSS = [(0, 0), (-1, 0), (1, 0), (0, -1), (0, 1)]
FOUR = CROSS[1:]
SQUARE = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]


def extremes() -> list[Column]:
    """Aggregates that ``geometry`` needs."""
    return [F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")]


def bounds(points: DataFrame, resolution: float, padding: float) -> DataFrame:
    """One row of map geometry: origin, width and height in cells."""
    return geometry(points.agg(*extremes()), resolution, padding)


def geometry(b: DataFrame, resolution: float, padding: float) -> DataFrame:
    """The same from a row of ``extremes``."""
    size = lambda a, z: (F.ceil((F.col(z) + padding - (F.col(a) - padding)) / F.lit(float(resolution))) + 1).cast("long")
    return b.select((F.col("x0") - padding).alias("ox"), (F.col("y0") - padding).alias("oy"), size("x0", "x1").alias("width"), size("y0", "y1").alias("height"))


def scaffold(meta: DataFrame) -> DataFrame:
    """Every cell of a map."""
    rows = meta.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("height") - 1)).alias("gy"))
    return rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("width") - 1)).alias("gx"))


def binned(points: DataFrame, meta: DataFrame, resolution: float) -> DataFrame:
    """Points with their cell, clipped to the map."""
    clip = lambda v, o, n: F.least(F.greatest(cell(F.col(v), resolution, F.col(o)), F.lit(0).cast("long")), F.col(n) - 1)
    return points.join(F.broadcast(meta)).withColumns({"gx": clip("x", "ox", "width"), "gy": clip("y", "oy", "height")}).drop("ox", "oy", "width", "height")


def occupancy(points: DataFrame, band: DataFrame, resolution: float = 0.05, padding: float = 0.5, least: int = 1, meta: DataFrame | None = None) -> DataFrame:
    """``(gy, gx, n, occupied)``: cells with ``least`` points of the band; the border is occupied.  ``band`` has one row (z_min, z_max).

    ``meta`` is the map's geometry, if it is known.
    """
    meta = bounds(points, resolution, padding) if meta is None else meta
    inside = points.join(F.broadcast(band)).where(F.col("z").between(F.col("z_min"), F.col("z_max")))
    counts = binned(inside.select("x", "y"), meta, resolution).groupBy("gy", "gx").agg(F.count(F.lit(1)).alias("n"))
    edge = (F.col("gy") == 0) | (F.col("gx") == 0) | (F.col("gy") == F.col("height") - 1) | (F.col("gx") == F.col("width") - 1)
    grid = scaffold(meta).join(counts, ["gy", "gx"], "left")
    return grid.select("gy", "gx", F.coalesce("n", F.lit(0)).alias("n"), (edge | (F.coalesce("n", F.lit(0)) >= max(1, least))).alias("occupied"))


def height_map(points: DataFrame, meta: DataFrame, resolution: float, percentile: float = 0.10, least: int = 1, by: tuple[str, ...] = ()) -> DataFrame:
    """``(gy, gx, n, z)``: a low percentile of the heights in every observed cell of ``least`` points.

    ``by`` names columns (of levels, or scenarios) whose values are maps of their own, here and below.
    """
    cells = binned(points.select(*by, "x", "y", "z"), meta, resolution)
    return by_group(cells, [*by, "gy", "gx"], "z", percentile).where(F.col("n") >= least)


def offsets(cells: DataFrame, steps, weights=None) -> DataFrame:
    """A constant table of steps ``(dy, dx, w)``."""
    rows = [(int(y), int(x), float(w)) for (y, x), w in zip(steps, weights or [1.0] * len(steps))]
    return F.broadcast(cells.sparkSession.createDataFrame(rows, "dy int, dx int, w double"))


def gathered(cells: DataFrame, value: str, steps, weights=None, by: tuple[str, ...] = ()) -> DataFrame:
    """For every cell, one row per step that meets a known neighbour: ``(gy, gx, dy, dx, w, near)``."""
    moved = cells.where(F.col(value).isNotNull()).join(offsets(cells, steps, weights))
    return moved.select(*by, (F.col("gy") - F.col("dy")).alias("gy"), (F.col("gx") - F.col("dx")).alias("gx"), "dy", "dx", "w", F.col(value).alias("near"))


def median3(cells: DataFrame, value: str = "z", by: tuple[str, ...] = ()) -> DataFrame:
    """Median of the known values in the 3 by 3 square, for known cells."""
    m = gathered(cells, value, SQUARE, by=by).groupBy(*by, "gy", "gx").agg(F.percentile("near", F.lit(0.5)).alias("__m"))
    return cells.join(m, [*by, "gy", "gx"], "left").withColumn(value, F.when(F.col(value).isNotNull(), F.col("__m"))).drop("__m")


def gaussian(cells: DataFrame, sigma: float, value: str = "z", by: tuple[str, ...] = ()) -> DataFrame:
    """Gaussian mean of the known values within ceil(2 sigma), weights made to sum to one, for known cells of a dense grid.

    The kernel is the product of one along the rows and one along the columns:
    two passes of windows, and no join.
    """
    import math

    r = math.ceil(2 * sigma)
    weights = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(-r, r + 1)]

    def pass_(df, columns, line, axis):
        order = Window.partitionBy(*by, line).orderBy(axis)
        at = lambda c, d: F.lag(c, d).over(order) if d > 0 else F.lead(c, -d).over(order) if d < 0 else F.col(c)
        blur = lambda c: sum((F.coalesce(at(c, d), F.lit(0.0)) * F.lit(w) for d, w in zip(range(-r, r + 1), weights)), F.lit(0.0))
        return df.withColumns({c: blur(c) for c in columns})

    df = cells.withColumns({"__v": F.coalesce(value, F.lit(0.0)), "__k": F.col(value).isNotNull().cast("double")})
    df = pass_(pass_(df, ("__v", "__k"), "gy", "gx"), ("__v", "__k"), "gx", "gy")
    return df.withColumn(value, F.when(F.col(value).isNotNull(), F.col("__v") / F.col("__k"))).drop("__v", "__k")


def fill_holes(cells: DataFrame, rounds: int, meta: DataFrame, value: str = "z", by: tuple[str, ...] = ()) -> DataFrame:
    """Unknown cells of a dense grid take the mean of their known 4-neighbours, round by round; neighbours wrap around the map.

    Each round is a window along the rows and one along the columns; the plan grows by those two alone.
    """
    cells = cells.join(F.broadcast(meta.select(F.col("width").alias("__w"), F.col("height").alias("__h"))))
    for _ in range(rounds):
        near = []
        for line, axis, size in (("gy", "gx", "__w"), ("gx", "gy", "__h")):
            order = Window.partitionBy(*by, line).orderBy(axis)
            whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
            before, after = f"__{axis}0", f"__{axis}1"
            cells = cells.withColumns(
                {
                    before: F.when(F.col(axis) == 0, F.last(value).over(whole)).otherwise(F.lag(value).over(order)),
                    after: F.when(F.col(axis) == F.col(size) - 1, F.first(value).over(whole)).otherwise(F.lead(value).over(order)),
                }
            )
            near += [before, after]
        known = sum((F.col(c).isNotNull().cast("int") for c in near[1:]), F.col(near[0]).isNotNull().cast("int"))
        total = sum((F.coalesce(c, F.lit(0.0)) for c in near[1:]), F.coalesce(near[0], F.lit(0.0)))
        cells = cells.withColumn(value, F.coalesce(F.col(value), F.when(known > 0, total / known))).drop(*near)
    return cells.drop("__w", "__h")


def gradients(cells: DataFrame, size: float, value: str = "z", by: tuple[str, ...] = ()) -> DataFrame:
    """Adds dzdx, dzdy (central differences, one-sided at the map's edge) and the slope in degrees."""
    row, column = Window.partitionBy(*by, "gy").orderBy("gx"), Window.partitionBy(*by, "gx").orderBy("gy")

    def d(window, axis):
        back, on = F.lag(value).over(window), F.lead(value).over(window)
        first, last = F.lag(axis).over(window).isNull(), F.lead(axis).over(window).isNull()
        here = F.col(value)
        return F.when(first, on - here).when(last, here - back).otherwise((on - back) / 2.0) / F.lit(float(size))

    out = cells.withColumns({"dzdx": d(row, "gx"), "dzdy": d(column, "gy")})
    return out.withColumn("slope", F.degrees(F.atan(F.sqrt(F.col("dzdx") * F.col("dzdx") + F.col("dzdy") * F.col("dzdy")))))


def step_height(cells: DataFrame, value: str = "z", by: tuple[str, ...] = ()) -> DataFrame:
    """Adds the largest difference to a known 4-neighbour, 0 if there is none."""
    keys = [*by, "gy", "gx"]
    near = gathered(cells, value, FOUR, by=by)
    most = near.join(cells.select(*keys, F.col(value).alias("__z")), keys).groupBy(*keys).agg(F.max(F.abs(F.col("near") - F.col("__z"))).alias("step"))
    return cells.join(most, keys, "left").withColumn("step", F.coalesce("step", F.lit(0.0)))


def rectangle(rx: int, ry: int) -> list[tuple[int, int]]:
    return [(dy, dx) for dy in range(-ry, ry + 1) for dx in range(-rx, rx + 1)]


def disc(r: int) -> list[tuple[int, int]]:
    return [(dy, dx) for dy, dx in rectangle(r, r) if dy * dy + dx * dx <= r * r]


def dilate(mask: DataFrame, steps, by: tuple[str, ...] = ()) -> DataFrame:
    """The cells within ``steps`` of a cell of the mask ``(gy, gx)``, not clipped."""
    return mask.join(offsets(mask, steps)).select(*by, (F.col("gy") + F.col("dy")).alias("gy"), (F.col("gx") + F.col("dx")).alias("gx")).distinct()


def dilate_rectangle(cells: DataFrame, flag: str, rx: int, ry: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Dilation of a flag on a dense grid by a rectangle: two passes of window functions, no join."""
    row = Window.partitionBy(*by, "gy").orderBy("gx").rangeBetween(-rx, rx)
    column = Window.partitionBy(*by, "gx").orderBy("gy").rangeBetween(-ry, ry)
    return cells.withColumn(flag, F.max(flag).over(row)).withColumn(flag, F.max(flag).over(column))


def close(cells: DataFrame, flag: str, radius: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Morphological closing with a cross: outside counts as empty while growing and as set while shrinking."""
    keys = [*by, "gy", "gx"]
    shape = [(dy, dx) for dy, dx in rectangle(radius, radius) if abs(dy) + abs(dx) <= radius]
    grown = dilate(cells.where(F.col(flag)).select(*keys), shape, by).withColumn("__on", F.lit(True))
    grown = cells.join(grown, keys, "left").withColumn("__on", F.coalesce("__on", F.lit(False)))
    gaps = dilate(grown.where(~F.col("__on")).select(*keys), shape, by).withColumn("__off", F.lit(True))
    return grown.join(gaps, keys, "left").withColumn(flag, F.col("__on") & F.col("__off").isNull()).drop("__on", "__off")


def tiles(cells: DataFrame, flag: str, step: int, rule: str) -> DataFrame:
    """``(ty, tx, flag)`` by tiles of ``step`` cells: ``all`` set, or ``any``; a partial tile is not all set, and counts as any."""
    full = F.count(F.lit(1)) == step * step
    hit = F.min(flag) & full if rule == "all" else F.max(flag) | ~full
    by = [F.floor(F.col(c) / step).cast("long").alias(t) for c, t in (("gy", "ty"), ("gx", "tx"))]
    return cells.groupBy(*by).agg(hit.alias(flag))


def upsample(tile_rows: DataFrame, cells: DataFrame, flag: str, step: int) -> DataFrame:
    """The flag of its tile for every cell."""
    keyed = cells.select("gy", "gx", F.floor(F.col("gy") / step).cast("long").alias("ty"), F.floor(F.col("gx") / step).cast("long").alias("tx"))
    return keyed.join(tile_rows, ["ty", "tx"]).select("gy", "gx", flag)


def prefix_sums(cells: DataFrame, value: str) -> DataFrame:
    """Adds the sum over the rectangle from the origin to each cell of a dense grid."""
    down = Window.partitionBy("gx").orderBy("gy").rowsBetween(Window.unboundedPreceding, 0)
    along = Window.partitionBy("gy").orderBy("gx").rowsBetween(Window.unboundedPreceding, 0)
    return cells.withColumn("__s", F.sum(value).over(down)).withColumn("prefix", F.sum("__s").over(along)).drop("__s")


def rectangle_sums(prefixed: DataFrame, boxes: DataFrame) -> DataFrame:
    """``boxes(id, y0, x0, y1, x1)``, inclusive, with the sum of each: four look-ups in the prefix sums."""
    corners = F.array(
        F.struct(F.col("y1").alias("gy"), F.col("x1").alias("gx"), F.lit(1).alias("s")), F.struct((F.col("y0") - 1).alias("gy"), F.col("x1").alias("gx"), F.lit(-1).alias("s")),
        F.struct(F.col("y1").alias("gy"), (F.col("x0") - 1).alias("gx"), F.lit(-1).alias("s")), F.struct((F.col("y0") - 1).alias("gy"), (F.col("x0") - 1).alias("gx"), F.lit(1).alias("s")),
    )
    looked = boxes.select("id", F.inline(corners)).join(prefixed.select("gy", "gx", "prefix"), ["gy", "gx"], "left")
    return looked.groupBy("id").agg(F.sum(F.col("s") * F.coalesce("prefix", F.lit(0))).alias("total"))


def pixel_classes(cells: DataFrame, free_thresh: float, occupied_thresh: float = 0.65) -> DataFrame:
    """Adds ``kind``: occupied, free or unknown, by the probability 1 - pixel / 255; free wins."""
    p = 1 - F.col("pixel") / 255.0
    return cells.withColumn("kind", F.when(p <= free_thresh, "free").when(p >= occupied_thresh, "occupied").otherwise("unknown"))


def blocked_cells(cells: DataFrame, free_thresh: float, negate: bool = False) -> DataFrame:
    """Adds ``blocked``: the pixel, negated if asked, lies under ceil(255 (1 - free_thresh))."""
    pixel = 255 - F.col("pixel") if negate else F.col("pixel")
    return cells.withColumn("blocked", pixel < F.ceil(F.lit(255 * (1 - free_thresh))))
