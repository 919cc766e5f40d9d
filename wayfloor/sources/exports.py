"""Reports, waypoints, colour layers and the project store."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def waypoints(path: DataFrame, ox: float, oy: float, resolution: float, height: int = 0) -> DataFrame:
    """``(seq, gy, gx)`` -> ``(seq, x, y)``; rows are flipped if the map's height is given."""
    row = (height - 1 - F.col("gy")) if height else F.col("gy")
    return path.select("seq", (ox + F.col("gx") * resolution).alias("x"), (oy + row * resolution).alias("y"))


def waypoint_lines(points: DataFrame) -> DataFrame:
    """One YAML list item a waypoint, for a text sink."""
    return points.orderBy("seq").select(F.format_string("- {x: %.4f, y: %.4f}", "x", "y").alias("value"))


def metric_rows(row: DataFrame) -> DataFrame:
    """A row of measures as ``(metric, value)`` rows, for a CSV sink."""
    pairs = F.array(*(F.struct(F.lit(c).alias("metric"), F.col(f"`{c}`").cast("string").alias("value")) for c in row.columns))
    return row.select(F.inline(pairs))


def report_lines(ramps: DataFrame) -> DataFrame:
    """One line of text a ramp, the steepest first."""
    return ramps.orderBy(F.desc("angle")).select(F.format_string("ramp %d: angle %.1f deg, length %.2f m, width %.2f m, rise %.2f m", "component", "angle", "length", "width", "rise").alias("value"))


def coverage_colours(cells: DataFrame) -> DataFrame:
    """``(blocked, floor, covered)`` flags -> a colour a cell; encoding an image is left to the caller."""
    pick = lambda a, b, c, d: F.when(F.col("blocked"), a).when(F.col("covered"), b).when(F.col("floor"), c).otherwise(d)
    return cells.select("gy", "gx", pick(0, 60, 220, 128).alias("r"), pick(0, 180, 80, 128).alias("g"), pick(0, 75, 60, 128).alias("b"))


def save_project(spark: SparkSession, folder: str, scalars: dict, tables: dict[str, DataFrame]) -> None:
    """Tables as Parquet, scalars and table names as one JSON manifest, all through Spark's writers."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
    manifest = json.dumps({"version": 2, "scalars": scalars, "tables": sorted(tables)})
    spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/manifest")


def load_project(spark: SparkSession, folder: str) -> tuple[dict, dict[str, DataFrame]]:
    manifest = json.loads("\n".join(r["value"] for r in spark.read.text(f"{folder}/manifest").collect()))
    return manifest["scalars"], {n: spark.read.parquet(f"{folder}/{n}") for n in manifest["tables"]}


def candidate_rows(candidates: DataFrame) -> DataFrame:
    """Removal candidates as text columns for a CSV sink."""
    names = ("rank", "label", "name", "fixation", "cells", "area", "unlock_area")
    return candidates.select(*(F.col(c).cast("string").alias(c) for c in names))


def validation_bundle(folder: str, layers: dict[str, DataFrame], resolution: float) -> None:
    """A folder with a table of colours for every layer and a summary of its counts, all through Spark's writers.

    ``layers`` may hold ``obstacle`` (blocked), ``reference`` and ``actual``
    (blocked, floor, covered); with both of these there is ``compare``, too.
    """
    from wayfloor.operators import maps as M

    if not layers:
        raise ValueError("no layers to export")
    rows = []
    for name, cells in layers.items():
        if name == "obstacle":
            shade = F.when(F.col("blocked"), 0).otherwise(254)
            colours, counts = cells.select("gy", "gx", *(shade.alias(c) for c in "rgb")), M.obstacle_counts(cells, resolution, "blocked")
        else:
            colours, counts = coverage_colours(cells), M.coverage_counts(cells)
        colours.write.mode("overwrite").parquet(f"{folder}/{name}")
        rows.append(metric_rows(counts).select(F.lit(name).alias("layer"), "metric", "value"))
    if "reference" in layers and "actual" in layers:
        both = layers["reference"].select("gy", "gx", F.col("covered").alias("ref")).join(layers["actual"].select("gy", "gx", F.col("covered").alias("act")), ["gy", "gx"])
        pick = lambda only, shared, none: F.when(F.col("ref") & F.col("act"), shared).when(F.col("ref"), only).otherwise(none)
        both.select("gy", "gx", pick(230, 60, 128).alias("r"), pick(90, 180, 128).alias("g"), pick(40, 75, 128).alias("b")).write.mode("overwrite").parquet(f"{folder}/compare")
        rows.append(metric_rows(M.compare_counts(both)).select(F.lit("compare").alias("layer"), "metric", "value"))
    summary = rows[0]
    for r in rows[1:]:
        summary = summary.unionByName(r)
    summary.write.mode("overwrite").option("header", True).csv(f"{folder}/summary")
