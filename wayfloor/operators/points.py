"""Point operators: filters, floor anchors, voxels, density, summaries.

Points are ``(x, y, z, ...)`` rows of doubles.  Everything is a projection, a
hash aggregation on integer cell keys, or a join on such keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfloor.functions.shared import saved
from wayfloor.operators.percentiles import percentile_row


def cell(value: Column, size: float, origin: Column | float = 0.0) -> Column:
    """Index of the cell that holds a coordinate: floor, as a long."""
    return F.floor((value - origin) / F.lit(float(size))).cast("long")


def finite(points: DataFrame, columns=("x", "y", "z")) -> DataFrame:
    """Rows whose coordinates are all numbers and not infinite."""
    keep = F.lit(True)
    for c in columns:
        keep = keep & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return points.where(keep)


def z_band(points: DataFrame, low: float | None, high: float | None) -> DataFrame:
    """Rows with z in [low, high]; None is open."""
    if low is not None:
        points = points.where(F.col("z") >= low)
    if high is not None:
        points = points.where(F.col("z") <= high)
    return points


def floor_preset(points: DataFrame) -> DataFrame:
    """One row: floor percentiles and the bands for cleaning and mapping that follow from them."""
    return preset_of(floor_percentiles(points))


def floor_percentiles(points: DataFrame, also: Sequence[Column] = ()) -> DataFrame:
    """The row that ``preset_of`` needs, and aggregates ``also`` from the same pass."""
    return percentile_row(points, "z", [0.02, 0.05], also=also)


def preset_of(p: DataFrame) -> DataFrame:
    """The same from a row of ``floor_percentiles``."""
    low, anchor = F.col("p")[0], F.col("p")[1]
    return p.select(
        low.alias("floor_low"), anchor.alias("anchor"), (low - 0.25).alias("clean_min"), (low + 4.0).alias("clean_max"),
        (anchor + 0.05).alias("map_min"), (anchor + 1.0).alias("map_max"),
    )


def projection_bounds(requests: DataFrame, points: DataFrame, percentile: float = 0.05) -> DataFrame:
    """``requests(mode, low, high)`` with the absolute band each stands for.

    ``auto`` is relative to the floor anchor unless a bound is negative; a missing bound is infinite.
    """
    anchor = percentile_row(points, "z", [percentile]).select(F.col("p")[0].alias("anchor"))
    negative = (F.coalesce("low", F.lit(0.0)) < 0) | (F.coalesce("high", F.lit(0.0)) < 0)
    relative = (F.col("mode") == "floor_relative") | ((F.col("mode") == "auto") & ~negative)
    shift = F.when(relative, F.col("anchor")).otherwise(0.0)
    return requests.join(F.broadcast(anchor)).select(
        "mode", "low", "high",
        F.coalesce(F.col("low") + shift, F.lit(float("-inf"))).alias("z_min"),
        F.coalesce(F.col("high") + shift, F.lit(float("inf"))).alias("z_max"),
    )


def sidecar_bounds(requests: DataFrame, preset: DataFrame, least_width: float = 2.0) -> DataFrame:
    """The requested terrain band where it is wide enough, else the preset's cleaning band."""
    keep = (F.col("high") > F.col("low")) & (F.col("high") - F.col("low") >= least_width)
    return requests.join(F.broadcast(preset)).select(
        "low", "high", F.when(keep, F.col("low")).otherwise(F.col("clean_min")).alias("z_min"), F.when(keep, F.col("high")).otherwise(F.col("clean_max")).alias("z_max")
    )


def voxel_downsample(points: DataFrame, size: float) -> DataFrame:
    """Mean point of every occupied voxel; no size, no change."""
    if size <= 0:
        return points
    keys = [cell(F.col(c), size).alias(f"v{c}") for c in "xyz"]
    return points.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(c) for c in "xyz"))


def neighbours(cells: DataFrame, keys: list[str], value: str, radius: int = 1) -> DataFrame:
    """For each cell, the sum of ``value`` over the cells within ``radius`` along every key, itself included."""
    from itertools import product

    names = [f"__d{k}" for k in keys]
    steps = cells.sparkSession.createDataFrame(list(product(range(-radius, radius + 1), repeat=len(keys))), ", ".join(f"{n} int" for n in names))
    moved = cells.select(*keys, value).join(F.broadcast(steps)).select(*((F.col(k) + F.col(n)).alias(k) for k, n in zip(keys, names)), value)
    spread = moved.groupBy(*keys).agg(F.sum(value).alias("around"))
    return cells.join(spread, keys)


def density_filter(points: DataFrame, radius: float, least: int, sor_std: float = 0.0) -> DataFrame:
    """Points of voxels whose 27-voxel neighbourhood is dense enough.

    The limit is ``least``, or the mean less ``sor_std`` deviations over the voxels if that is more.
    """
    keyed = points.withColumns({f"__v{c}": cell(F.col(c), radius) for c in "xyz"})
    keys = ["__vx", "__vy", "__vz"]
    dense = neighbours(keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")), keys, "__n")
    if sor_std > 0:
        limit = dense.agg(F.greatest(F.lit(float(least)), F.lit(1.0), F.avg("around") - sor_std * F.stddev_pop("around")).alias("__limit"))
        dense = dense.join(F.broadcast(limit)).where(F.col("around") >= F.col("__limit"))
    else:
        dense = dense.where(F.col("around") >= max(1, least))
    return keyed.join(dense.select(*keys), keys, "left_semi").drop(*keys)


def preclean(points: DataFrame, z_min: float, z_max: float, voxel: float, ror_radius: float, ror_min: int, sor_std: float = 0.0) -> DataFrame:
    """Finite, z band, voxels, then the density filter, once with a fixed and once with a statistical limit."""
    out = z_band(finite(points), z_min, z_max)
    out = voxel_downsample(out.select("x", "y", "z"), voxel).select("x", "y", "z")
    if ror_radius > 0 and ror_min > 0:
        out = density_filter(out, ror_radius, ror_min)
    if sor_std > 0:
        out = density_filter(out, max(ror_radius, voxel, 0.05), 1, sor_std)
    return out


def noise_filter_2d(points: DataFrame, radius: float = 0.5, least: int = 100) -> DataFrame:
    """Points whose column of cells has ``least`` points within ``radius``, by cells of max(radius / 2.5, 0.1)."""
    size = max(radius / 2.5, 0.1)
    reach = max(1, round(radius / size))
    keyed = points.withColumns({"__gx": cell(F.col("x"), size), "__gy": cell(F.col("y"), size)})
    around = neighbours(keyed.groupBy("__gx", "__gy").agg(F.count(F.lit(1)).alias("__n")), ["__gx", "__gy"], "__n", reach)
    return keyed.join(around.where(F.col("around") >= least).select("__gx", "__gy"), ["__gx", "__gy"], "left_semi").drop("__gx", "__gy")


def z_summary(points: DataFrame) -> DataFrame:
    p = points.agg(
        F.count("z").alias("n"), F.min("z").alias("z_min"), F.max("z").alias("z_max"), F.avg("z").alias("z_mean"),
    ).join(F.broadcast(percentile_row(points, "z", [0.02, 0.05, 0.5, 0.95])))
    return p.select("n", "z_min", "z_max", "z_mean", F.col("p")[0].alias("p2"), F.col("p")[1].alias("p5"), F.col("p")[2].alias("median"), F.col("p")[3].alias("p95"))


def z_bins(points: DataFrame, width: float = 0.25) -> DataFrame:
    return points.groupBy(cell(F.col("z"), width).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def adaptive_threshold(counts: DataFrame, requested: int, keep: float = 0.75, count_col: str = "n") -> DataFrame:
    """The largest number of points a cell at which a share ``keep`` of the cells stays, from ``requested`` down to half of it, 2 at least."""
    low = max(2, requested // 2)
    candidates = [requested, *range(requested - 1, low - 1, -1)]
    share = counts.agg(*(F.avg((F.col(count_col) >= c).cast("double")).alias(f"s{c}") for c in candidates))
    applied = F.lit(low)
    for c in reversed(candidates):
        applied = F.when(F.col(f"s{c}") >= keep, F.lit(c)).otherwise(applied)
    fraction = F.lit(None).cast("double")
    for c in candidates:
        fraction = F.when(F.col("applied") == c, F.col(f"s{c}")).otherwise(fraction)
    return share.withColumn("applied", applied).select(
        F.lit(requested).alias("requested"), "applied", F.when(F.col("applied") == requested, "requested").otherwise("adaptive").alias("mode"), fraction.alias("keep_fraction")
    )


def rotate(points: DataFrame, degrees: float, inverse: bool = False) -> DataFrame:
    """Rotation in the plane; ``inverse`` turns back."""
    a = F.radians(F.lit(-float(degrees) if inverse else float(degrees)))
    return points.withColumns({"x": F.col("x") * F.cos(a) - F.col("y") * F.sin(a), "y": F.col("x") * F.sin(a) + F.col("y") * F.cos(a)})


def height_colours(points: DataFrame) -> DataFrame:
    """Colour by height between the 5th and 95th percentile, along five stops."""
    # The stops of the ramp (position, red, green, blue).
    stops = [(0.0, 0.0, 0.0, 1.0), (0.25, 0.0, 1.0, 1.0), (0.5, 1.0, 1.0, 0.0), (0.75, 1.0, 0.0, 0.0), (1.0, 1.0, 0.0, 0.0)]
    p = percentile_row(points, "z", [0.05, 0.95], "__p")
    span = F.when(F.col("__p")[1] > F.col("__p")[0], F.col("__p")[1] - F.col("__p")[0]).otherwise(1.0)
    t = points.join(F.broadcast(p)).withColumn("t", F.least(F.greatest((F.col("z") - F.col("__p")[0]) / span, F.lit(0.0)), F.lit(1.0))).drop("__p")
    for i, name in enumerate(("r", "g", "b"), 1):
        value = F.lit(stops[-1][i])
        for (at, *low), (to, *high) in reversed(list(zip(stops, stops[1:]))):
            value = F.when(F.col("t") < to, low[i - 1] + (F.col("t") - at) / (to - at) * (high[i - 1] - low[i - 1])).otherwise(value)
        t = t.withColumn(name, value)
    return t


def stride(points: DataFrame, step: int, order: list[str]) -> DataFrame:
    """Every ``step``-th row in an order.  Rows are numbered by range partitions and their sizes, not in one task."""
    spread = points.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = spread.select("*", F.spark_partition_id().alias("__p"), F.monotonically_increasing_id().alias("__m"))
    numbered = saved(numbered.withColumn("__i", F.col("__m").bitwiseAND((1 << 33) - 1)))
    counts = numbered.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.alias("a").join(counts.alias("b"), F.col("a.__p") > F.col("b.__p"), "left").groupBy(F.col("a.__p").alias("__p")).agg(F.coalesce(F.sum("b.__n"), F.lit(0)).alias("__before"))
    return numbered.join(F.broadcast(before), "__p").where((F.col("__before") + F.col("__i")) % step == 0).drop("__p", "__m", "__i", "__before")
