"""Robot footprints as columns and as cell offsets."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def footprint_pixels(robots: DataFrame, resolution: float, fallback: float = 0.35) -> DataFrame:
    """Adds the half sizes in cells: of the rectangle, else the radius, else a fallback radius."""
    size = lambda half: F.ceil(F.coalesce(half, "radius", F.lit(fallback)) / F.lit(resolution))
    return robots.select("*", size("half_w").alias("infl_x"), size("half_l").alias("infl_y"), F.col("half_w").isNotNull().alias("is_rect"))


def parameters(robots: DataFrame) -> DataFrame:
    """Planning radius and half sizes with the safety margin; a rectangle's radius is half its diagonal."""
    round_ = F.col("shape") == "circle"
    diagonal = F.sqrt(F.col("width") * F.col("width") / 4 + F.col("length") * F.col("length") / 4)
    grown = lambda rect: F.when(round_, F.col("radius")).otherwise(rect) + F.col("inflation")
    return robots.select(
        "name", "shape", grown(diagonal).alias("radius"), grown(F.col("width") / 2).alias("half_w"), grown(F.col("length") / 2).alias("half_l"), F.col("inflation").alias("inflation_radius")
    )


def circle_offsets(radius: float, resolution: float) -> list[tuple[int, int]]:
    """Cells whose centre lies within the radius and half a cell."""
    r = math.ceil(radius / resolution) + 1
    return [(y, x) for y in range(-r, r + 1) for x in range(-r, r + 1) if (y * y + x * x) * resolution**2 <= (radius + resolution / 2) ** 2]


def rectangle_offsets(half_w: float, half_l: float, angle: float, resolution: float, samples: int = 3) -> list[tuple[int, int]]:
    """Cells of which some point of a ``samples`` by ``samples`` lattice lies in the rectangle, turned by the angle (radians)."""
    r = math.ceil(math.hypot(half_w, half_l) / resolution) + 1
    c, s = math.cos(angle), math.sin(angle)
    shift = [(k + 0.5) / samples - 0.5 for k in range(samples)]

    def inside(y, x):
        return abs(x * c + y * s) <= half_l + 1e-9 and abs(-x * s + y * c) <= half_w + 1e-9

    return [(y, x) for y in range(-r, r + 1) for x in range(-r, r + 1) if any(inside((y + a) * resolution, (x + b) * resolution) for a in shift for b in shift)]


def sweep_offsets(half_w: float, half_l: float, start: float, stop: float, resolution: float, samples: int = 5) -> list[tuple[int, int]]:
    """The union of the rectangle's cells at ``samples`` angles between two."""
    cells: set[tuple[int, int]] = set()
    for i in range(samples):
        cells.update(rectangle_offsets(half_w, half_l, start + (stop - start) * i / (samples - 1), resolution))
    return sorted(cells)
