"""Tours of maps along a spanning tree, without a sequential search.

The free cells of a map are joined by a tree: cells along their runs, runs by
the least edges between them (each round every part of the forest takes its
least edge out, so rounds grow with the logarithm).  A tour goes along every
edge of the tree once each way; the step after entering a cell is to the cell's
next neighbour in turn, so all steps are known at once, and their order comes
from ranking that list by pointer doubling, in logarithmically many joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfloor.functions.shared import discard, saved
from wayfloor.operators import components as C

#: Directions of a step by number; the way back has 3 less the number.
TURNS = ((-1, 0), (0, -1), (0, 1), (1, 0))


def spanning_forest(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """The least edges ``(s, t)``, s < t, that join what ``edges(s, t)`` join: a tree for every component, the same whatever the order."""
    left = saved(edges.select(F.least("s", "t").alias("s"), F.greatest("s", "t").alias("t")).where("s <> t").distinct().select("s", "t", F.col("s").alias("a"), F.col("t").alias("b")))
    tree = None
    for _ in range(max_rounds):
        if not left.limit(1).count():
            return edges.select("s", "t").limit(0) if tree is None else tree
        sides = left.select("s", "t", "a", "b", F.explode(F.array("a", "b")).alias("part"))
        taken = saved(sides.groupBy("part").agg(F.min(F.struct("s", "t", "a", "b")).alias("e")).select("e.*").distinct())
        both = taken.select("a", "b").unionByName(taken.select(F.col("b").alias("a"), F.col("a").alias("b"))).select(F.col("a").alias("s"), F.col("b").alias("t")).distinct()
        labels = saved(C.spread_labels(both.select(F.col("s").alias("id")).distinct(), both, C.LOCAL_EDGES))
        of = lambda end: labels.select(F.col("id").alias(end), F.col("label").alias(f"of_{end}"))
        new = left.join(of("a"), "a", "left").join(of("b"), "b", "left").select("s", "t", F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
        tree = taken.select("s", "t") if tree is None else tree.unionByName(taken.select("s", "t"))
        new = saved(new.where("a <> b"))
        discard(left, labels)
        left = new
    raise RuntimeError("the forest did not settle; raise max_rounds")


def _tree_steps(cells: DataFrame) -> DataFrame:
    """``cells(map_id, gy, gx)``, one component a map -> ``(map_id, gy, gx, turn)``: the steps along a tree's edges, both ways."""
    runs = saved(C.runs(cells, ["map_id", "gy"]))
    number = lambda y, x: ((F.col("map_id") * C.PITCH + F.col(y)) * C.PITCH + F.col(x)).cast("long")
    named = runs.select("map_id", "gy", "a", "b", number("gy", "a").alias("id"))
    below = named.select("map_id", (F.col("gy") - 1).alias("gy"), F.col("a").alias("a2"), F.col("b").alias("b2"), F.col("id").alias("id2"))
    touching = saved(named.join(below, ["map_id", "gy"]).where((F.col("a") <= F.col("b2")) & (F.col("a2") <= F.col("b"))))
    tree = spanning_forest(touching.select(F.col("id").alias("s"), F.col("id2").alias("t")))
    # The run above has the lesser number, so that an edge's s is the upper run.
    down = touching.join(tree.select(F.col("s").alias("id"), F.col("t").alias("id2")), ["id", "id2"], "left_semi").select("map_id", "gy", F.greatest("a", "a2").alias("gx"))
    along = runs.where("b > a").select("map_id", "gy", F.explode(F.sequence("a", F.col("b") - 1)).alias("gx"))
    step = lambda df, turn, back: df.select("map_id", "gy", "gx", F.lit(turn).alias("turn")).unionByName(
        df.select("map_id", (F.col("gy") + TURNS[turn][0]).alias("gy"), (F.col("gx") + TURNS[turn][1]).alias("gx"), F.lit(back).alias("turn"))
    )
    return step(down, 3, 0).unionByName(step(along, 2, 1))


def ranked(links: DataFrame, max_rounds: int = 64) -> DataFrame:
    """``links(id, next)``, lists whose last has a null ``next`` -> ``(id, behind)``: how many follow."""
    now = saved(links.select("id", "next", F.when(F.col("next").isNull(), 0).otherwise(1).cast("long").alias("behind")))
    for _ in range(max_rounds):
        if not now.where("next IS NOT NULL").limit(1).count():
            return now.select("id", "behind")
        before = now
        for _ in range(2):  # two doublings a job
            to = now.select(F.col("id").alias("next"), F.col("next").alias("further"), F.col("behind").alias("more"))
            going = now.where("next IS NOT NULL").join(to, "next").select("id", F.col("further").alias("next"), (F.col("behind") + F.col("more")).alias("behind"))
            settled = now.where("next IS NULL")
            now = settled.unionByName(going)
        now = saved(now)
        discard(before)
    raise RuntimeError("the lists did not end; raise max_rounds")


def tree_tours(cells: DataFrame) -> DataFrame:
    """``(map_id, gy, gx)`` -> ``(map_id, seq, gy, gx)``: a closed walk over the largest component of every map.

    It begins at the least cell, row by row, and goes along every edge of a
    spanning tree once each way: of n cells it takes 2n - 1 visits.  ``map_id``
    is a small integer, rows and columns are below 2^24.  Repeated rows count
    once; a map without cells has no tour.
    """
    cells = cells.select(F.col("map_id").cast("long").alias("map_id"), F.col("gy").cast("long").alias("gy"), F.col("gx").cast("long").alias("gx"))
    kept = saved(C.largest(C.components(cells, by="map_id"), "map_id").select("map_id", "gy", "gx"))
    steps = saved(_tree_steps(kept).select(((F.col("map_id") * C.PITCH + F.col("gy")) * C.PITCH + F.col("gx")).alias("cell"), "turn", "map_id", "gy", "gx"))
    dy, dx = (F.element_at(F.array(*(F.lit(t[i]) for t in TURNS)), F.col("turn") + 1) for i in (0, 1))
    # In turn: the neighbour after the one that was come from.
    cell = Window.partitionBy("cell").orderBy("turn")
    turning = steps.select("cell", F.col("turn").alias("back"), F.coalesce(F.lead("turn").over(cell), F.min("turn").over(Window.partitionBy("cell"))).alias("on"))
    to = steps.withColumns({"ty": F.col("gy") + dy, "tx": F.col("gx") + dx})
    to = to.withColumns({"into": (F.col("map_id") * C.PITCH + F.col("ty")) * C.PITCH + F.col("tx"), "back": 3 - F.col("turn"), "id": F.col("cell") * 4 + F.col("turn")})
    turning = turning.select(F.col("cell").alias("into"), "back", (F.col("cell") * 4 + F.col("on")).alias("next"))
    listed = saved(to.join(turning, ["into", "back"]).select("id", "next", "map_id", "ty", "tx", "cell"))
    root = saved(kept.groupBy("map_id").agg(F.min(F.struct("gy", "gx")).alias("r")).select("map_id", "r.gy", "r.gx"))
    first = listed.groupBy("map_id").agg(F.min("id").alias("begin"), F.count(F.lit(1)).alias("n"))  # of the least cell, its least turn
    cut = listed.join(first, "map_id").withColumn("next", F.when(F.col("next") != F.col("begin"), F.col("next")))
    order = ranked(cut.select("id", "next"))
    walk = cut.join(order, "id").select("map_id", (F.col("n") - F.col("behind")).alias("seq"), F.col("ty").alias("gy"), F.col("tx").alias("gx"))
    return root.select("map_id", F.lit(0).cast("long").alias("seq"), "gy", "gx").unionByName(walk)
