"""Label operators: dimension tables, projection of labels to cells, gap attribution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfloor.operators.points import cell

# Label, name, fixation group, colour (red, green, blue).
LABELS = [
    (0, "Unlabelled / Background", "Fixed", 80, 80, 80),
    (1, "Wall", "Fixed", 255, 170, 255),
    (3, "Staircase", "Fixed", 249, 241, 0),
    (4, "Fixed Obstacles", "Fixed", 85, 170, 255),
    (5, "Temporary Ramps", "Semi-Fixed", 255, 0, 0),
    (6, "Safety Barriers and Signs", "Semi-Fixed", 142, 106, 36),
    (7, "Temporary Utilities", "Semi-Fixed", 255, 0, 127),
    (8, "Scaffold Structure", "Semi-Fixed", 170, 255, 255),
    (9, "Semi-Fixed Obstacles", "Semi-Fixed", 170, 170, 255),
    (10, "Large Materials", "Movable", 85, 85, 0),
    (11, "Stored Equipment", "Movable", 132, 132, 140),
    (12, "Mobile Machines and Vehicles", "Movable", 170, 255, 0),
    (13, "Movable Objects", "Movable", 179, 20, 176),
    (14, "Containers and Pallets", "Portable", 0, 170, 255),
    (15, "Small Tools", "Portable", 255, 85, 127),
    (17, "Portable Objects", "Portable", 250, 255, 147),
]
# Fixation groups in order of priority.
PRIORITY = ["Portable", "Movable", "Semi-Fixed", "Fixed", "Unknown"]
# Scenarios and the fixation groups each removes.
LAYERS = [
    (0, "Actual site state", []),
    (1, "Portable removed", ["Portable"]),
    (2, "Portable + Movable removed", ["Portable", "Movable"]),
    (3, "Structural maximum (only Fixed remains)", ["Portable", "Movable", "Semi-Fixed"]),
]
NO_LABEL = -1


def label_dimension(spark: SparkSession) -> DataFrame:
    """``(label, name, fixation, priority, r, g, b)``: 16 rows, so a broadcast is bounded."""
    rows = [(i, n, f, PRIORITY.index(f), r, g, b) for i, n, f, r, g, b in LABELS]
    return spark.createDataFrame(rows, "label int, name string, fixation string, priority int, r int, g int, b int")


def clip_labels(points: DataFrame) -> DataFrame:
    return points.withColumn("label", F.least(F.greatest(F.col("label"), F.lit(0)), F.lit(17)))


def label_cells(points: DataFrame, size: float, ox: float = 0.0, oy: float = 0.0) -> DataFrame:
    """``(gy, gx, label, n)``: the most frequent label of every cell, the least of equal ones."""
    counts = points.groupBy(cell(F.col("y"), size, oy).alias("gy"), cell(F.col("x"), size, ox).alias("gx"), "label").agg(F.count(F.lit(1)).alias("n"))
    best = F.max(F.struct("n", (-F.col("label")).alias("l")))
    return counts.groupBy("gy", "gx").agg(best.alias("m")).select("gy", "gx", (-F.col("m.l")).cast("int").alias("label"), F.col("m.n").alias("n"))


def gap_by_label(missed: DataFrame, labels: DataFrame, dimension: DataFrame, cell_area: float) -> DataFrame:
    """Missed area by label, with names; cells without a label count under -1, and ids without a name not at all."""
    joined = missed.join(labels.select("gy", "gx", "label"), ["gy", "gx"], "left").withColumn("label", F.coalesce("label", F.lit(NO_LABEL)))
    by = joined.groupBy("label").agg(F.count(F.lit(1)).alias("cells"))
    total = missed.agg(F.count(F.lit(1)).alias("total"))
    named = by.join(F.broadcast(dimension), "label", "left").where(F.col("name").isNotNull() | (F.col("label") == NO_LABEL))
    return named.join(F.broadcast(total)).select(
        "label",
        F.coalesce("name", F.lit("No semantic data")).alias("name"),
        F.coalesce("fixation", F.lit("Unknown")).alias("fixation"),
        F.coalesce("priority", F.lit(PRIORITY.index("Unknown"))).alias("priority"),
        "cells",
        (F.col("cells") * cell_area).alias("area"),
        (100.0 * F.col("cells") / F.col("total")).alias("pct"),
    )


def gap_by_fixation(gap: DataFrame) -> DataFrame:
    return gap.groupBy("fixation", "priority").agg(F.sum("cells").alias("cells"), F.sum("area").alias("area"), F.sum("pct").alias("pct"))


def recommendations(gap: DataFrame, k: int = 3) -> DataFrame:
    """The k labels to act on first: by priority, then by area; background and walls cannot be acted on."""
    rank = F.row_number().over(Window.orderBy("priority", F.desc("area"), "label"))
    return gap.where(~F.col("label").isin(-1, 0, 1)).withColumn("rank", rank).where(F.col("rank") <= k)


def layer_scenarios(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, n, g) for i, n, g in LAYERS], "scenario int, layer string, removed array<string>")


def without_groups(blocked: DataFrame, scenarios: DataFrame, dimension: DataFrame) -> DataFrame:
    """``blocked(gy, gx, label)`` once per scenario, less the cells whose label's group the scenario removes."""
    named = blocked.join(F.broadcast(dimension.select("label", "fixation")), "label", "left")
    return named.join(F.broadcast(scenarios)).where(~F.coalesce(F.array_contains("removed", F.col("fixation")), F.lit(False))).select("scenario", "gy", "gx")
