"""Where an object could stand: fit by prefix sums, distance to its like, scores."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfloor.functions.shared import saved
from wayfloor.operators import grid as G
from wayfloor.operators import horizontal as H
from wayfloor.operators.greedy import apart

#: Zones nearer than this (Manhattan, cells) to a better one are dropped; so many are tried.
APART, TRIED = 20, 80


def placements(cells: DataFrame, height: int, width: int) -> DataFrame:
    """Top-left cells ``(gy, gx)`` at which a box of free floor fits; ``cells(gy, gx, free)`` is dense."""
    sums = G.prefix_sums(cells.withColumn("__f", F.col("free").cast("long")), "__f").select("gy", "gx", "prefix")
    corners = [(height - 1, width - 1, 1), (-1, width - 1, -1), (height - 1, -1, -1), (-1, -1, 1)]
    total = None
    for dy, dx, sign in corners:
        part = sums.select((F.col("gy") - dy).alias("gy"), (F.col("gx") - dx).alias("gx"), (F.col("prefix") * sign).alias("p"))
        total = part if total is None else total.unionByName(part)
    return total.groupBy("gy", "gx").agg(F.sum("p").alias("n")).where(F.col("n") == height * width).join(cells.select("gy", "gx"), ["gy", "gx"], "left_semi").select("gy", "gx")


def peer_distance(zones: DataFrame, peers: DataFrame, cap: float, resolution: float) -> DataFrame:
    """Distance to the nearest cell of ``peers``, up to ``cap`` metres (the cap where none is nearer).

    Both sides are keyed by squares of the cap's size, so a zone meets the peers of nine squares.
    """
    side = math.ceil(cap / resolution)
    keyed = zones.select("gy", "gx", F.floor(F.col("gy") / side).alias("ty"), F.floor(F.col("gx") / side).alias("tx"))
    near = F.sequence(F.lit(-1), F.lit(1))
    spread = peers.select(F.col("gy").alias("py"), F.col("gx").alias("px")).select("*", F.explode(near).alias("a")).select("*", F.explode(near).alias("b"))
    spread = spread.select("py", "px", (F.floor(F.col("py") / side) + F.col("a")).alias("ty"), (F.floor(F.col("px") / side) + F.col("b")).alias("tx"))
    d = F.sqrt((F.col("gy") - F.col("py")) ** 2 + (F.col("gx") - F.col("px")) ** 2) * resolution
    best = keyed.join(spread, ["ty", "tx"]).groupBy("gy", "gx").agg(F.min(d).alias("d"))
    return zones.join(best, ["gy", "gx"], "left").withColumn("distance", F.least(F.coalesce("d", F.lit(float(cap))), F.lit(float(cap)))).drop("d")


def ranked(zones: DataFrame, peer_weight: float = 0.05, distance_weight: float = 0.25, farthest: float = 8.0, k: int = 5) -> DataFrame:
    """``(zone_id, gain, peer, distance)`` -> the best k: net gain first, near its like, not far away."""
    score = F.col("gain") + peer_weight * F.col("peer") - distance_weight * F.col("distance")
    ties = [F.desc("walls")] if "walls" in zones.columns else []
    relaxed = ["relax"] if "relax" in zones.columns else []
    by = (*relaxed, F.desc("score"), F.desc("peer"), "distance", *ties, "zone_id")
    kept = zones.where((F.col("gain") > 0) & (F.col("distance") <= farthest)).withColumn("score", score)
    # The best k are few rows; only those are numbered.
    return kept.orderBy(*by).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*by)))


def translated(cells: DataFrame, dy: int, dx: int) -> DataFrame:
    """Object cells moved and clipped to the map: ``(gy, gx, height, width)``."""
    moved = cells.withColumns({"gy": F.col("gy") + dy, "gx": F.col("gx") + dx})
    return moved.where(F.col("gy").between(0, F.col("height") - 1) & F.col("gx").between(0, F.col("width") - 1))


def relocated(cells: DataFrame, thing: DataFrame, dy: int, dx: int) -> DataFrame:
    """The map ``cells(gy, gx, blocked, floor)`` after an object ``thing(gy, gx)`` is moved by hand.

    Where it stood is free floor, where it stands now is not; what of it would
    leave the map is gone.
    """
    to = thing.select((F.col("gy") + dy).alias("gy"), (F.col("gx") + dx).alias("gx"))
    out = _flag(_flag(cells, thing, "__own"), to, "__now")
    blocked = (F.col("blocked") & ~F.col("__own")) | F.col("__now")
    return out.select("gy", "gx", blocked.alias("blocked"), ((F.col("floor") | F.col("__own")) & ~F.col("__now")).alias("floor"))


def _flag(cells: DataFrame, marked: DataFrame, name: str) -> DataFrame:
    on = marked.select("gy", "gx").distinct().withColumn("__on", F.lit(True))
    return cells.join(on, ["gy", "gx"], "left").withColumn(name, F.coalesce("__on", F.lit(False))).drop("__on")


def doorways(cells: DataFrame) -> DataFrame:
    """Free cells with at most two free 4-neighbours."""
    near = G.gathered(cells.withColumn("__v", (~F.col("blocked")).cast("int")), "__v", G.FOUR).groupBy("gy", "gx").agg(F.sum("near").alias("__n"))
    return cells.where("NOT blocked").join(near, ["gy", "gx"], "left").where(F.coalesce("__n", F.lit(0)) <= 2).select("gy", "gx")


def _apart(candidates: DataFrame) -> DataFrame:
    """Down the order of ``score``, candidates ``(gy, gx, score)`` that are not near a better one, ``TRIED`` of them, numbered from 0."""
    number = F.col("gy").cast("long") * (1 << 24) + F.col("gx")
    places = saved(candidates.select("gy", "gx", "score").distinct().select("gy", "gx", number.alias("id"), F.col("gy").alias("y"), F.col("gx").alias("x"), F.struct(-F.col("score"), "gy", "gx").alias("rank")))
    kept = places.join(apart(places, APART, manhattan=True), "id", "left_semi").orderBy("rank").limit(TRIED)
    # The first few are one small group.
    return kept.withColumn("zone_id", (F.row_number().over(Window.orderBy("rank")) - 1).cast("long")).select("zone_id", F.col("gy").cast("long").alias("gy"), F.col("gx").cast("long").alias("gx"))


def relocation_zones(cells: DataFrame, thing: DataFrame, rx: int, ry: int, resolution: float, peers: DataFrame | None = None, relax: int | tuple[int, ...] = 0, k: int = 5) -> DataFrame:
    """The best places for an object ``thing(gy, gx)`` of a dense map ``cells(gy, gx, blocked, floor)``.

    A place fits the object's box into floor that is reached once the object is
    gone; below ``relax`` 2 it keeps clear of the robot's present floor, below 1
    of doorways.  Of those, best first by walls around, no two near each other,
    each is tried: all maps with the object at its place are scored in one job,
    those of several values of ``relax`` too; the less relaxed zones rank first.
    Places count that open floor within eight metres; gain, nearness to
    ``peers(gy, gx)`` and distance rank them.
    """
    cells = saved(cells.select("gy", "gx", "blocked", "floor"))
    box = thing.agg(*(f(c).alias(f"{n}_{c}") for c in ("gy", "gx") for n, f in (("min", F.min), ("max", F.max), ("avg", F.avg)))).first()
    tall, wide = box["max_gy"] - box["min_gy"] + 1, box["max_gx"] - box["min_gx"] + 1
    cleared = saved(_flag(cells, thing, "__own").withColumn("blocked", F.col("blocked") & ~F.col("__own")).drop("__own"))
    now = saved(H.reach(cells, rx, ry))
    then = H.reach(cleared, rx, ry)
    before = now.agg(F.coalesce(F.sum(F.col("accessible").cast("long")), F.lit(0))).first()[0]

    short = max(1, min(rx, ry))
    near = G.dilate_rectangle(now.select("gy", "gx", "accessible"), "accessible", short, short).where("accessible")
    walls = G.gathered(cells.withColumn("__b", F.col("blocked").cast("int")), "__b", [c for c in G.SQUARE if c != (0, 0)]).groupBy("gy", "gx").agg(F.sum("near").alias("walls"))
    flags = saved(_flag(_flag(cells, near, "busy"), doorways(cells), "door").join(walls, ["gy", "gx"], "left"))
    fits = saved(placements(then.withColumn("free", F.col("accessible") & ~F.col("blocked")), tall, wide))
    levels = (relax,) if isinstance(relax, int) else tuple(relax)
    need = F.lit(2)
    if min(levels) < 2:
        number = F.col("gy") * (1 << 24) + F.col("gx")
        boxes = fits.select(number.alias("id"), F.col("gy").alias("y0"), F.col("gx").alias("x0"), (F.col("gy") + tall - 1).alias("y1"), (F.col("gx") + wide - 1).alias("x1"))
        fits = fits.withColumn("id", number)
        for flag in ("busy", "door"):
            sums = G.prefix_sums(flags.withColumn("__v", F.col(flag).cast("long")), "__v")
            fits = fits.join(G.rectangle_sums(sums, boxes).select("id", (F.col("total") == 0).alias(f"{flag}_clear")), "id")
        need = F.when(F.col("busy_clear") & F.col("door_clear"), 0).when(F.col("busy_clear"), 1).otherwise(2)
    fits = fits.select("gy", "gx", need.alias("need"))
    scored = saved(fits.join(flags.select("gy", "gx", "busy", F.coalesce("walls", F.lit(0)).alias("walls")), ["gy", "gx"]).withColumn("score", F.when(F.col("busy"), -1000.0).otherwise(0.0) + F.col("walls")))
    zones = None
    for i, level in enumerate(levels):
        own = _apart(scored.where(F.col("need") <= level)).select((F.col("zone_id") + i * TRIED).alias("zone_id"), F.lit(level).alias("relax"), "gy", "gx")
        zones = own if zones is None else zones.unionByName(own)
    zones = saved(zones)

    # A place is tried once, whatever rules allow it.
    places = saved(zones.groupBy("gy", "gx").agg(F.min("zone_id").alias("place")))
    spots = F.broadcast(places.select(F.col("place").cast("int").alias("zone"), F.col("gy").alias("zy"), F.col("gx").alias("zx")))
    inside = F.col("gy").between(F.col("zy"), F.col("zy") + tall - 1) & F.col("gx").between(F.col("zx"), F.col("zx") + wide - 1)
    tries = cleared.join(spots).select("zone", "gy", "gx", (F.col("blocked") | inside).alias("blocked"), "floor")
    after = H.reach(tries, rx, ry, "zone").groupBy(F.col("zone").cast("long").alias("place")).agg(F.sum(F.col("accessible").cast("long")).alias("n"))
    away = F.sqrt((F.col("gy") + tall / 2.0 - box["avg_gy"]) ** 2 + (F.col("gx") + wide / 2.0 - box["avg_gx"]) ** 2) * resolution
    out = zones.join(places, ["gy", "gx"]).join(after, "place").join(flags.select("gy", "gx", F.coalesce("walls", F.lit(0)).alias("walls")), ["gy", "gx"])
    out = out.withColumns({"gain": (F.col("n") - before) * resolution * resolution, "distance": away})
    if peers is None:
        out = out.withColumn("peer", F.lit(0.0))
    else:
        others = peers.select("gy", "gx").join(thing.select("gy", "gx"), ["gy", "gx"], "left_anti")
        middle = zones.select("zone_id", (F.col("gy") + tall // 2).alias("gy"), (F.col("gx") + wide // 2).alias("gx"))
        reach = peer_distance(middle.select("gy", "gx").distinct(), others, 50.0, resolution)
        out = out.join(middle.join(reach, ["gy", "gx"]).select("zone_id", (1.0 / (1.0 + F.col("distance"))).alias("peer")), "zone_id")
    return ranked(out.select("zone_id", "relax", "gy", "gx", F.lit(tall).alias("height"), F.lit(wide).alias("width"), "gain", "peer", "distance", "walls"), k=k)


def relocate(cells: DataFrame, objects: DataFrame, order: list, rx: int, ry: int, resolution: float) -> tuple[DataFrame, list[dict]]:
    """Move objects ``(component, gy, gx)`` one after the other to their best places; the map after that, and the moves.

    Each move changes the map that the next is judged on, so objects follow one
    another; all places of one are scored in one job, under all rules, of which
    the strictest that finds a place counts.  Without one the object stays.
    """
    moves = []
    for component in order:
        thing = saved(objects.where(F.col("component") == component).select("gy", "gx"))
        for z in relocation_zones(cells, thing, rx, ry, resolution, relax=(0, 1, 2), k=1).collect():
            inside = F.col("gy").between(z["gy"], z["gy"] + z["height"] - 1) & F.col("gx").between(z["gx"], z["gx"] + z["width"] - 1)
            cells = saved(_flag(cells, thing, "__own").withColumn("blocked", (F.col("blocked") & ~F.col("__own")) | inside).drop("__own"))
            moves.append({"component": component, "gy": z["gy"], "gx": z["gx"], "relax": z["relax"], "gain": z["gain"], "distance": z["distance"]})
    return cells, moves
