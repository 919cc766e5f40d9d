"""Floor that a robot's body covers: poses without collision, sweeps in stripes, footprints stamped along a path.

Poses are rows ``(k, gy, gx)``, k one of ``HEADINGS`` headings; footprints are
small constant tables of offsets.  Only the search among poses is sequential
(``planners.reachable_poses``); the rest are joins and windows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfloor.functions.shared import saved
from wayfloor.operators import components as C
from wayfloor.operators import grid as G
from wayfloor.operators import horizontal as H
from wayfloor.operators import robots as B
from wayfloor.operators.planners import HEADINGS, reachable_poses

MODES = ("inflation", "footprint_fit", "coverage_path")


def _prints(cells: DataFrame, half_w: float, half_l: float, resolution: float, turning: bool = False, circular: bool = False) -> DataFrame:
    """``(k, dy, dx)``: the cells of the footprint at every heading, or of the turn to the next."""
    step = 2 * math.pi / HEADINGS
    rows = []
    for k in range(HEADINGS):
        if circular:
            found = B.circle_offsets(max(half_w, half_l), resolution)
        elif turning:
            found = B.sweep_offsets(half_w, half_l, k * step, (k + 1) * step, resolution)
        else:
            found = B.rectangle_offsets(half_w, half_l, k * step, resolution)
        rows += [(k, y, x) for y, x in found]
    return F.broadcast(cells.sparkSession.createDataFrame(rows, "k int, dy int, dx int"))


def pose_space(cells: DataFrame, half_w: float, half_l: float, resolution: float, safety: int = 1, circular: bool = False) -> DataFrame:
    """``cells(gy, gx, blocked)``, dense -> ``(k, gy, gx, turn)``: poses whose body is clear, and whether it may turn to k + 1.

    Obstacles are first grown by a box of ``safety`` cells.
    """
    blocked = cells.where("blocked").select("gy", "gx")
    if safety:
        blocked = saved(G.dilate(blocked, G.rectangle(safety, safety)).join(cells.select("gy", "gx"), ["gy", "gx"], "left_semi"))

    def hit(prints):
        at = blocked.join(prints).select("k", (F.col("gy") - F.col("dy")).alias("gy"), (F.col("gx") - F.col("dx")).alias("gx"))
        return at.distinct()

    poses = cells.select("gy", "gx", F.explode(F.sequence(F.lit(0), F.lit(HEADINGS - 1))).alias("k"))
    clear = poses.join(hit(_prints(cells, half_w, half_l, resolution, circular=circular)), ["k", "gy", "gx"], "left_anti")
    if circular:
        return clear.withColumn("turn", F.lit(True)).select("k", "gy", "gx", "turn")
    stuck = hit(_prints(cells, half_w, half_l, resolution, turning=True)).withColumn("__stuck", F.lit(True))
    return clear.join(stuck, ["k", "gy", "gx"], "left").select("k", "gy", "gx", F.col("__stuck").isNull().alias("turn"))


def stamped(path: DataFrame, offsets, free: DataFrame) -> DataFrame:
    """Free cells under a footprint that stands at every cell of a path ``(gy, gx)``."""
    return G.dilate(path.select("gy", "gx").distinct(), offsets).join(free.select("gy", "gx"), ["gy", "gx"], "left_semi")


def stripe_step(half_w: float, resolution: float, overlap: float = 0.10) -> int:
    """Rows from one stripe to the next: the body's width less the overlap, one at least."""
    width = max(resolution, 2.0 * half_w * (1.0 - min(0.9, max(0.0, overlap))))
    return max(1, round(width / resolution))


def zigzag(centres: DataFrame, anchor: int, step: int) -> DataFrame:
    """``(seq, stripe, forward, gy, gx)``: the rows of the centres that lie whole steps from the anchor, back and forth in turn.

    Stripes are numbered over the few rows of the map; cells inside a row by a window of that row.
    """
    rows = centres.where(F.pmod(F.col("gy") - anchor, F.lit(step)) == 0).select("gy", "gx").distinct()
    order = Window.orderBy("gy")
    stripes = rows.groupBy("gy").agg(F.count(F.lit(1)).alias("n")).withColumns(
        {"stripe": F.row_number().over(order) - 1, "before": F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))}
    )
    forward = F.col("stripe") % 2 == 0
    at = rows.join(F.broadcast(stripes), "gy").withColumn("forward", forward)
    inside = F.row_number().over(Window.partitionBy("gy").orderBy(F.when(F.col("forward"), F.col("gx")).otherwise(-F.col("gx"))))
    return at.withColumn("i", inside).select((F.col("before") + F.col("i") - 1).alias("seq"), "stripe", "forward", "gy", "gx")


def traffic(path: DataFrame, tile: int) -> DataFrame:
    """Visits of a path by tiles of so many cells."""
    return path.groupBy(F.floor(F.col("gy") / tile).alias("ty"), F.floor(F.col("gx") / tile).alias("tx")).agg(F.count(F.lit(1)).alias("visits"))


def covered(cells: DataFrame, mode: str, half_w: float, half_l: float, resolution: float, start: tuple[int, int] = (0, 0), model: str = "differential", safety: int = 1, overlap: float = 0.10) -> DataFrame:
    """``cells(gy, gx, blocked, floor)`` with ``accessible``, by one of three ways.

    ``inflation`` keeps the largest component after growing obstacles;
    ``footprint_fit`` is what the body sweeps at all poses reached from the
    start by the motion model; ``coverage_path`` is what it sweeps along a
    zigzag over the centres reached heading east or west.
    """
    if mode not in MODES:
        raise ValueError(f"no mode {mode}; there are {', '.join(MODES)}")
    if mode == "inflation":
        return H.reach(cells, math.ceil(half_w / resolution), math.ceil(half_l / resolution))
    poses = pose_space(cells, half_w, half_l, resolution, safety).withColumn("map_id", F.lit(0).cast("long"))
    seen = saved(reachable_poses(poses, start, model))
    free = cells.where("NOT blocked")
    if mode == "footprint_fit":
        prints = _prints(cells, half_w, half_l, resolution)
        swept = seen.join(prints, "k").select((F.col("gy") + F.col("dy")).alias("gy"), (F.col("gx") + F.col("dx")).alias("gx")).distinct()
        swept = swept.join(free.select("gy", "gx"), ["gy", "gx"], "left_semi")
    else:
        path = zigzag(seen.where(F.col("k").isin(0, HEADINGS // 2)), start[0], stripe_step(half_w, resolution, overlap))
        swept = stamped(path, B.rectangle_offsets(half_w, half_l, 0.0, resolution), free)
    joined = cells.join(swept.withColumn("__in", F.lit(True)), ["gy", "gx"], "left")
    return joined.withColumn("accessible", F.coalesce("__in", F.lit(False)) & F.col("floor")).drop("__in")


def start_component(free: DataFrame, start: tuple[int, int], least: int = 10) -> tuple[DataFrame, DataFrame]:
    """The component of ``free(gy, gx)`` to cover, and the cell to start from.

    It is the one that holds the start if it has more than ``least`` cells, else
    the largest; one begins at its cell nearest to the start.
    """
    labelled = saved(C.components(free.select("gy", "gx")))
    own = labelled.where((F.col("gy") == start[0]) & (F.col("gx") == start[1])).select("component")
    wanted = C.sizes(labelled).join(own.withColumn("own", F.lit(True)), "component", "left").withColumn("own", F.coalesce("own", F.lit(False)) & (F.col("n") > least))
    best = wanted.agg(F.max_by("component", F.struct("own", "n", (-F.col("component")).alias("c"))).alias("component"))
    kept = labelled.join(F.broadcast(best), "component", "left_semi").select("gy", "gx")
    far = (F.col("gy") - start[0]) * (F.col("gy") - start[0]) + (F.col("gx") - start[1]) * (F.col("gx") - start[1])
    return kept, kept.agg(F.min(F.struct(far.alias("far"), "gy", "gx")).alias("s")).select("s.gy", "s.gx")
