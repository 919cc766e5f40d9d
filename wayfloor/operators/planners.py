"""Coverage paths, shortest walks and poses on maps.

Cells are ``(map_id, gy, gx)``, the free cells of each map.  Poses are reached
by contracting a graph in rounds of joins (``components.reached``); the order of
a path is a sequential search, one grouped task a map.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfloor.functions.shared import saved
from wayfloor.operators.components import PITCH, reached

STEPS = ((1, 0), (-1, 0), (0, 1), (0, -1))  # down, up, right, left


def shortest(free: set, start: tuple, goals) -> list[tuple]:
    """Breadth-first walk from start to the nearest goal, both ends included; empty if there is none."""
    goals = goals if isinstance(goals, (set, frozenset)) else {goals}
    came, ring = {start: None}, [start]
    while ring:
        for c in ring:
            if c in goals:
                path = [c]
                while came[path[-1]] is not None:
                    path.append(came[path[-1]])
                return path[::-1]
        nxt = []
        for y, x in ring:
            for dy, dx in STEPS:
                c = (y + dy, x + dx)
                if c in free and c not in came:
                    came[c] = (y, x)
                    nxt.append(c)
        ring = nxt
    return []


def a_star(free: set, start: tuple, goal: tuple) -> list[tuple]:
    """Shortest walk with the Manhattan distance as the estimate."""
    far = lambda c: abs(c[0] - goal[0]) + abs(c[1] - goal[1])
    heap, came, cost = [(far(start), 0, start)], {start: None}, {start: 0}
    while heap:
        _, g, c = heapq.heappop(heap)
        if c == goal:
            path = [c]
            while came[path[-1]] is not None:
                path.append(came[path[-1]])
            return path[::-1]
        for dy, dx in STEPS:
            n = (c[0] + dy, c[1] + dx)
            if n in free and g + 1 < cost.get(n, 1 << 60):
                cost[n], came[n] = g + 1, c
                heapq.heappush(heap, (g + 1 + far(n), g + 1, n))
    return []


def _largest(free: set) -> set:
    left, best = set(free), set()
    for c in sorted(free):
        if c in left:
            part, ring = {c}, [c]
            while ring:
                ring = [n for y, x in ring for n in ((y + dy, x + dx) for dy, dx in STEPS) if n in left and n not in part and not part.add(n)]
            left -= part
            best = part if len(part) > len(best) else best
    return best


def spanning_tree(free: set) -> list[tuple]:
    """Tour of a depth-first tree from the first cell, with the way back along its edges."""
    seen, path, stack = set(), [], []
    first = min(free)
    seen.add(first)
    path.append(first)
    stack.append((first, iter(((0, 1), (0, -1), (1, 0), (-1, 0)))))
    while stack:
        (y, x), steps = stack[-1]
        for dy, dx in steps:
            c = (y + dy, x + dx)
            if c in free and c not in seen:
                seen.add(c)
                path.append(c)
                stack.append((c, iter(((0, 1), (0, -1), (1, 0), (-1, 0)))))
                break
        else:
            stack.pop()
            if stack:
                path.append(stack[-1][0])
    return path


def _linked(free: set, order: list[tuple]) -> list[tuple]:
    """Visits in an order, with shortest walks between cells that are no neighbours."""
    path = [order[0]]
    for c in order[1:]:
        if abs(c[0] - path[-1][0]) + abs(c[1] - path[-1][1]) == 1:
            path.append(c)
        else:
            path += shortest(free, path[-1], c)[1:]
    return path


def column_sweep(free: set) -> list[tuple]:
    return _linked(free, sorted(free, key=lambda c: (c[1], c[0] if c[1] % 2 == 0 else -c[0])))


def wavefront(free: set) -> list[tuple]:
    """From the cells furthest from the centre inwards: rings by falling distance, each by nearest next cell."""
    cy, cx = sum(c[0] for c in free) // len(free), sum(c[1] for c in free) // len(free)
    start = (cy, cx) if (cy, cx) in free else min(free)
    dist, ring, d = {start: 0}, [start], 0
    while ring:
        d += 1
        nxt = []
        for y, x in ring:
            for dy, dx in STEPS:
                c = (y + dy, x + dx)
                if c in free and c not in dist:
                    dist[c] = d
                    nxt.append(c)
        ring = nxt
    order, at = [], None
    by_distance: dict[int, set] = {}
    for c, k in dist.items():
        by_distance.setdefault(k, set()).add(c)
    for k in sorted(by_distance, reverse=True):
        left = by_distance[k]
        while left:
            at = min(left) if at is None else min(left, key=lambda c: (abs(c[0] - at[0]) + abs(c[1] - at[1]), c))
            left.discard(at)
            order.append(at)
    return _linked(free, order)


def column_runs(free: set) -> list[tuple]:
    """Depth-first over the vertical runs and their overlaps, sweeping each up and down in turn."""
    runs, of = [], {}
    for y, x in sorted(free, key=lambda c: (c[1], c[0])):
        if runs and runs[-1][0] == x and runs[-1][2] == y - 1:
            runs[-1][2] = y
        else:
            runs.append([x, y, y])
        of[(y, x)] = len(runs) - 1
    near: list[set] = [set() for _ in runs]
    for (y, x), i in of.items():
        if (j := of.get((y, x + 1))) is not None:
            near[i].add(j)
            near[j].add(i)
    order, seen, stack, down = [], set(), [0], True
    while stack:
        i = stack.pop()
        if i in seen:
            continue
        seen.add(i)
        x, a, b = runs[i]
        order += [(y, x) for y in (range(a, b + 1) if down else range(b, a - 1, -1))]
        down = not down
        stack += sorted(near[i] - seen, reverse=True)
    return _linked(free, order)


def frontier(free: set) -> list[tuple]:
    """From the cell nearest the centre, always to the nearest cell not visited."""
    cy, cx = sum(c[0] for c in free) / len(free), sum(c[1] for c in free) / len(free)
    path = [min(free, key=lambda c: (abs(c[0] - cy) + abs(c[1] - cx), c))]
    left = set(free) - {path[0]}
    while left:
        way = shortest(free, path[-1], left)
        path += way[1:]
        left.difference_update(way)
    return path


def spiral(free: set) -> list[tuple]:
    """Turn, straight on, turn the other way, back: the first that leads to a new cell; else jump to the nearest new one."""
    heading = ((0, 1), (1, 0), (0, -1), (-1, 0))
    path, d = [min(free)], 0
    left = set(free) - {path[0]}
    while left:
        y, x = path[-1]
        for turn in (1, 0, -1, 2):
            dy, dx = heading[(d + turn) % 4]
            if (y + dy, x + dx) in left:
                d = (d + turn) % 4
                path.append((y + dy, x + dx))
                break
        else:
            way = shortest(free, (y, x), left)
            path += a_star(free, (y, x), way[-1])[1:]
        left.discard(path[-1])
    return path


PLANNERS = {"stc": spanning_tree, "bcd": column_sweep, "wavefront": wavefront, "morse": column_runs, "frontier": frontier, "spiral": spiral}


def coverage_paths(cells: DataFrame, planner: str = "spiral") -> DataFrame:
    """``(map_id, gy, gx)`` -> ``(map_id, seq, gy, gx)``: a path of neighbouring cells over the largest component of every map."""
    if planner not in PLANNERS:
        raise ValueError(f"no planner {planner}; there are {', '.join(PLANNERS)}")
    plan = PLANNERS[planner]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        free = _largest(set(zip(pdf["gy"].tolist(), pdf["gx"].tolist())))
        path = plan(free)
        return pd.DataFrame({"map_id": pdf["map_id"].iloc[0], "seq": range(len(path)), "gy": [c[0] for c in path], "gx": [c[1] for c in path]})

    return cells.select("map_id", "gy", "gx").groupBy("map_id").applyInPandas(run, "map_id long, seq long, gy long, gx long")


#: Turns of the footprint: headings of a full circle.
HEADINGS = 16
# Moves by heading in eighths of a circle.
EIGHTHS = ((0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1))


def pose_moves(model: str, k: int) -> list[tuple[int, int]]:
    """Translations that a motion model allows at heading k."""
    if model == "holonomic":
        return list(EIGHTHS)
    if model == "holonomic_xy":
        return [EIGHTHS[i] for i in (0, 2, 4, 6)]
    if k % 2:
        return []
    e = k // 2
    return [EIGHTHS[e]] if model == "differential" else [EIGHTHS[(e + i) % 8] for i in (0, 2, 4, 6)]


def pose_groups(free: DataFrame) -> DataFrame:
    """``free(map_id, k, gy, gx[, turn])`` with ``node``: the headings of a centre that turns connect are one node.

    Headings go round: the last one turns to the first.  Nodes are numbered by
    map, centre and least heading.
    """
    turn = F.col("turn") if "turn" in free.columns else F.lit(True)
    centre = Window.partitionBy("map_id", "gy", "gx")
    upto = centre.orderBy("k")
    poses = free.select("map_id", F.col("k").cast("int").alias("k"), F.col("gy").cast("long").alias("gy"), F.col("gx").cast("long").alias("gx"), turn.alias("turn"))
    begins = F.coalesce((F.lag("k").over(upto) != F.col("k") - 1) | ~F.lag("turn").over(upto), F.lit(True))
    first = F.max(F.when(F.col("begins"), F.col("k"))).over(upto)
    chained = poses.withColumn("begins", begins).withColumn("first", first)
    round_ = F.max(((F.col("k") == HEADINGS - 1) & F.col("turn")).cast("int")).over(centre) == 1
    chained = chained.withColumn("first", F.when(round_ & (F.min("k").over(centre) == 0) & (F.col("first") == F.max("first").over(centre)), 0).otherwise(F.col("first")))
    number = ((F.col("map_id") * PITCH + F.col("gy")) * PITCH + F.col("gx")) * HEADINGS + F.col("first")
    return chained.select("map_id", "k", "gy", "gx", number.cast("long").alias("node"))


def pose_edges(nodes: DataFrame, model: str) -> DataFrame:
    """Directed edges ``(s, t)`` between the nodes of ``pose_groups``: the translations of a motion model; a diagonal step needs both cells beside it."""
    rows = [(k, y, x) for k in range(HEADINGS) for y, x in pose_moves(model, k)]
    moves = F.broadcast(nodes.sparkSession.createDataFrame(rows, "k int, dy long, dx long"))
    to = nodes.join(moves, "k").select("map_id", "k", F.col("node").alias("s"), "dy", "dx", "gy", "gx", (F.col("gy") + F.col("dy")).alias("ty"), (F.col("gx") + F.col("dx")).alias("tx"))
    there = nodes.select("map_id", "k", F.col("gy").alias("ty"), F.col("gx").alias("tx"), F.col("node").alias("t"))
    found = to.join(there, ["map_id", "k", "ty", "tx"])
    straight = found.where("dy = 0 OR dx = 0").select("s", "t")
    aslant = found.where("dy <> 0 AND dx <> 0")
    for y, x in (("ty", "gx"), ("gy", "tx")):
        beside = nodes.select("map_id", "k", F.col("gy").alias(y), F.col("gx").alias(x))
        aslant = aslant.join(beside, ["map_id", "k", y, x], "left_semi")
    return straight.unionByName(aslant.select("s", "t")).distinct()


MODELS = ("differential", "combined", "holonomic", "holonomic_xy")


def reachable_poses(free: DataFrame, seed: tuple[int, int], model: str = "differential") -> DataFrame:
    """``free(map_id, k, gy, gx[, turn])``, the poses without collision -> those reached from any heading at the seed.

    A seed without an open pose gives way to the nearest centre that has one.
    A turn goes to the next heading either way, if ``turn`` of the lower of the
    two allows it; a diagonal step needs both cells beside it.  All maps are
    searched in the same rounds; ``map_id`` is a small integer, rows and
    columns are below 2^24.
    """
    if model not in MODELS:
        raise ValueError(f"no model {model}; there are {', '.join(MODELS)}")
    nodes = saved(pose_groups(free))
    return _reached_poses(nodes, pose_edges(nodes, model), seed)


def _reached_poses(nodes: DataFrame, edges: DataFrame, seed: tuple[int, int]) -> DataFrame:
    far = F.abs(F.col("gy") - seed[0]) + F.abs(F.col("gx") - seed[1])
    begin = nodes.groupBy("map_id").agg(F.min(F.struct(far.alias("far"), "gy", "gx")).alias("b")).select("map_id", "b.gy", "b.gx")
    seeds = nodes.join(begin, ["map_id", "gy", "gx"], "left_semi").select(F.col("node").alias("id")).distinct()
    seen = reached(edges, seeds).select(F.col("id").alias("node"))
    return nodes.join(seen, "node", "left_semi").select(F.col("map_id").cast("long").alias("map_id"), "k", "gy", "gx")


def reachable_by_model(free: DataFrame, seed: tuple[int, int]) -> DataFrame:
    """``free(k, gy, gx[, turn])`` of one map -> ``(model, k, gy, gx)``: what every motion model reaches, all in the same rounds."""
    number = F.explode(F.sequence(F.lit(0), F.lit(len(MODELS) - 1))).alias("map_id")
    nodes = saved(pose_groups(free.drop("map_id").select("*", number)))
    edges = None
    for i, model in enumerate(MODELS):
        own = pose_edges(nodes.where(F.col("map_id") == i), model)
        edges = own if edges is None else edges.unionByName(own)
    seen = _reached_poses(nodes, edges, seed)
    return seen.select(F.element_at(F.array(*map(F.lit, MODELS)), F.col("map_id").cast("int") + 1).alias("model"), "k", "gy", "gx")
