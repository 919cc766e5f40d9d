"""Directed reachability by contraction, against a plain search."""

import random

import pytest

from wayfloor.operators.components import reached
from wayfloor.operators.planners import HEADINGS, pose_moves, reachable_poses


def plain(edges, seeds):
    to = {}
    for s, t in edges:
        to.setdefault(s, []).append(t)
    seen, ring = set(seeds), list(seeds)
    while ring:
        for t in to.get(ring.pop(), []):
            if t not in seen:
                seen.add(t)
                ring.append(t)
    return seen


@pytest.mark.parametrize("seed", range(4))
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    n = 40
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range([20, 45, 60, 90][seed])]
    edges += [(t, s) for s, t in edges[: seed * 5]] + edges[:3]
    edges += [(100, 101), (101, 102), (102, 100), (102, 3)]  # a ring that nothing leads to, and that leads on
    seeds = [rng.randrange(n), rng.randrange(n)]
    got = reached(spark.createDataFrame(edges, "s long, t long"), spark.createDataFrame([(i,) for i in seeds], "id long"))
    assert {r.id for r in got.collect()} == plain(edges, seeds)


def test_long_lanes_and_nothing(spark):
    lane = [(i, i + 1) for i in range(500)]
    got = reached(spark.createDataFrame(lane, "s long, t long"), spark.createDataFrame([(200,)], "id long"), max_rounds=2)
    assert {r.id for r in got.collect()} == set(range(200, 501))
    empty = spark.createDataFrame(lane, "s long, t long").limit(0)
    assert reached(empty, empty.select(empty.s.alias("id"))).count() == 0
    assert [r.id for r in reached(empty, spark.createDataFrame([(7,)], "id long")).collect()] == [7]


@pytest.mark.parametrize("model", ["differential", "combined", "holonomic", "holonomic_xy"])
def test_poses_of_random_maps(spark, model):
    """Random open poses and turns, so that lanes are one-way, diagonal and without room to turn."""
    rng = random.Random(model)
    rows = [(m, k, y, x, rng.random() < 0.4) for m in (0, 3) for k in range(HEADINGS) for y in range(6) for x in range(8) if rng.random() < 0.75]
    want = set()
    for m in (0, 3):
        open_ = {(k, y, x) for q, k, y, x, _ in rows if q == m}
        fixed = {(k, y, x) for q, k, y, x, turn in rows if q == m and not turn}
        edges = []
        for k, y, x in open_:
            nxt = ((k + 1) % HEADINGS, y, x)
            if nxt in open_ and (k, y, x) not in fixed:
                edges += [((k, y, x), nxt), (nxt, (k, y, x))]
            for dy, dx in pose_moves(model, k):
                if (k, y + dy, x + dx) in open_ and (not (dy and dx) or ((k, y + dy, x) in open_ and (k, y, x + dx) in open_)):
                    edges.append(((k, y, x), (k, y + dy, x + dx)))
        _, *at = min((abs(y - 2) + abs(x - 2), y, x) for _, y, x in open_)
        want |= {(m, *p) for p in plain(edges, {(k, *at) for k in range(HEADINGS)} & open_)}
    got = reachable_poses(spark.createDataFrame(rows, "map_id int, k int, gy long, gx long, turn boolean"), (2, 2), model).collect()
    assert {(r.map_id, r.k, r.gy, r.gx) for r in got} == want and len(got) == len(want)
