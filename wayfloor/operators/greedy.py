"""Greedy choice of places that are apart: down an order, each one that no better choice is near.

The rule reads like a sequential loop, but a place only depends on the better
ones near it.  Places are keyed by squares so small that all of a square are
near each other: of each, only the best undecided one can be chosen next, and it
is compared with the undecided ones of the squares around.  All that are best
around are chosen in one round, and what is near them is settled.  Rounds grow
with the longest chain of places that wait for each other, not with their number;
a place meets a bounded number of others in each.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfloor.functions.shared import discard, saved

#: Places up to which the choice is made in one task.
LOCAL_PLACES = 20_000


def _distance(manhattan: bool):
    dy, dx = F.col("y") - F.col("cy"), F.col("x") - F.col("cx")
    return F.abs(dy) + F.abs(dx) if manhattan else F.sqrt(dy * dy + dx * dx)


def _around(choices: DataFrame, side: float, radius: float) -> DataFrame:
    """``choices(sy, sx, id, y, x, rank)`` as ``(sy, sx, cid, cy, cx, crank)`` of every square that may hold something near."""
    n = math.ceil(radius / side)
    near = F.sequence(F.lit(-n), F.lit(n))
    spread = choices.select("*", F.explode(near).alias("a")).select("*", F.explode(near).alias("b"))
    return spread.select((F.col("sy") + F.col("a")).alias("sy"), (F.col("sx") + F.col("b")).alias("sx"), F.col("id").alias("cid"), F.col("y").alias("cy"), F.col("x").alias("cx"), F.col("rank").alias("crank"))


def _in_one_task(places: DataFrame, radius: float, manhattan: bool) -> DataFrame:
    """The loop itself, for a checked, small number of places."""

    def run(batches):
        rows = sorted((r for b in batches for r in zip(*(b.column(i).to_pylist() for i in (3, 0, 1, 2)))))
        kept: dict[tuple[int, int], list] = {}
        out = []
        for _, i, y, x in rows:
            sy, sx = math.floor(y / radius), math.floor(x / radius)
            near = (c for a in (-1, 0, 1) for b in (-1, 0, 1) for c in kept.get((sy + a, sx + b), ()))
            if not any((abs(y - v) + abs(x - u) if manhattan else math.sqrt((y - v) ** 2 + (x - u) ** 2)) < radius for v, u in near):
                kept.setdefault((sy, sx), []).append((y, x))
                out.append(i)
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], names=["id"])

    ranked = places.select("id", "y", "x", "rank").orderBy("rank").coalesce(1)
    return ranked.withColumn("rank", F.monotonically_increasing_id()).mapInArrow(run, "id long")


def apart(places: DataFrame, radius: float, manhattan: bool = False, local: int = LOCAL_PLACES, max_rounds: int = 10_000) -> DataFrame:
    """Ids of ``places(id, y, x, rank)`` that are chosen: by ``rank``, least first, those nearer than ``radius`` to no chosen one.

    ``rank`` is any type that orders, ids are unique; of places with equal rank
    the lesser id comes first.
    """
    places = places.select("id", F.col("y").cast("double").alias("y"), F.col("x").cast("double").alias("x"), F.struct("rank", "id").alias("rank"))
    places = saved(places)
    if places.limit(local + 1).count() <= local:
        return _in_one_task(places, radius, manhattan)
    side = radius / (2.001 if manhattan else 1.5)
    square = lambda c: F.floor(F.col(c) / side).cast("long")
    left = places.withColumns({"sy": square("y"), "sx": square("x")})
    chosen = None
    for _ in range(max_rounds):
        best = left.groupBy("sy", "sx").agg(F.min_by(F.struct("id", "y", "x", "rank"), "rank").alias("b")).select("sy", "sx", "b.*")
        held = saved(best)
        beaten = left.join(_around(held, side, radius), ["sy", "sx"]).where((F.col("rank") < F.col("crank")) & (_distance(manhattan) < radius)).select(F.col("cid").alias("id")).distinct()
        new = saved(held.join(beaten, "id", "left_anti").select("sy", "sx", "id", "y", "x", "rank"))
        chosen = new.select("id") if chosen is None else chosen.unionByName(new.select("id"))
        near = left.join(_around(new, side, radius), ["sy", "sx"]).where(_distance(manhattan) < radius).select("id").distinct()
        rest = saved(left.join(near, "id", "left_anti"))
        discard(held, *([left] if hasattr(left, "_saved_at") else []))
        left = rest
        if not left.limit(1).count():
            return chosen
    raise RuntimeError("the choice did not settle; raise max_rounds")


def nearest_choice(places: DataFrame, chosen: DataFrame, radius: float) -> DataFrame:
    """``(id, choice)``: for every place the first by rank of the chosen ones nearer than the radius, itself if it is one."""
    square = lambda c: F.floor(F.col(c) / radius).cast("long")
    keyed = places.select("id", F.col("y").cast("double").alias("y"), F.col("x").cast("double").alias("x"), F.struct("rank", "id").alias("rank")).withColumns({"sy": square("y"), "sx": square("x")})
    seeds = keyed.join(chosen.select("id"), "id", "left_semi")
    met = keyed.join(_around(seeds, radius, radius), ["sy", "sx"]).where((F.col("id") == F.col("cid")) | (_distance(False) < radius))
    return met.groupBy("id").agg(F.min_by("cid", "crank").alias("choice"))
