"""Poses, sweeps and starts against plain versions on small maps."""

import math
from collections import deque

import pytest

from wayfloor.operators import coverage as O
from wayfloor.operators import robots as B
from wayfloor.operators.planners import HEADINGS, pose_moves

ROOM = [
    "################",
    "#..............#",
    "#..............#",
    "#..............#",
    "#......#########",
    "#..............#",
    "#..............#",
    "#..............#",
    "#..............#",
    "################",
]


def cells_of(spark, room):
    rows = [(y, x, c == "#", c != "#") for y, line in enumerate(room) for x, c in enumerate(line)]
    return spark.createDataFrame(rows, "gy long, gx long, blocked boolean, floor boolean")


def plain(room, half_w, half_l, res, start, model, safety):
    h, w = len(room), len(room[0])
    wall = {(y, x) for y in range(h) for x in range(w) if room[y][x] == "#"}
    wall = {(y + a, x + b) for y, x in wall for a in range(-safety, safety + 1) for b in range(-safety, safety + 1)}
    step = 2 * math.pi / HEADINGS
    body = [B.rectangle_offsets(half_w, half_l, k * step, res) for k in range(HEADINGS)]
    turn = [B.sweep_offsets(half_w, half_l, k * step, (k + 1) * step, res) for k in range(HEADINGS)]
    clear = lambda prints, y, x: not any((y + a, x + b) in wall for a, b in prints)
    open_ = {(k, y, x) for k in range(HEADINGS) for y in range(h) for x in range(w) if clear(body[k], y, x)}
    seen = {(k, *start) for k in range(HEADINGS)} & open_
    ring = deque(seen)
    while ring:
        k, y, x = ring.popleft()
        to = [((k + s) % HEADINGS, y, x) for s in (1, -1) if clear(turn[k if s == 1 else (k - 1) % HEADINGS], y, x)]
        for dy, dx in pose_moves(model, k):
            if not (dy and dx) or ((k, y + dy, x) in open_ and (k, y, x + dx) in open_):
                to.append((k, y + dy, x + dx))
        for p in to:
            if p in open_ and p not in seen:
                seen.add(p)
                ring.append(p)
    return seen, body


@pytest.mark.parametrize("model", ["differential", "combined", "holonomic", "holonomic_xy"])
def test_footprint_fit(spark, model):
    seen, body = plain(ROOM, 0.08, 0.14, 0.1, (2, 2), model, 0)
    want = {(y + a, x + b) for k, y, x in seen for a, b in body[k]}
    want = {(y, x) for y, x in want if 0 <= y < len(ROOM) and 0 <= x < len(ROOM[0]) and ROOM[y][x] != "#"}
    got = O.covered(cells_of(spark, ROOM), "footprint_fit", 0.08, 0.14, 0.1, (2, 2), model, safety=0).where("accessible").collect()
    assert {(r.gy, r.gx) for r in got} == want and want


def test_coverage_path(spark):
    seen, _ = plain(ROOM, 0.08, 0.14, 0.1, (2, 2), "combined", 0)
    step = O.stripe_step(0.08, 0.1)
    rows = sorted({y for k, y, x in seen if k in (0, 8) and (y - 2) % step == 0})
    path = []
    for i, y in enumerate(rows):
        path += sorted(((y, x) for x in {x for k, b, x in seen if k in (0, 8) and b == y}), reverse=bool(i % 2))
    centres = spark.createDataFrame([(y, x) for k, y, x in seen if k in (0, 8)], "gy long, gx long")
    got = O.zigzag(centres, 2, step).orderBy("seq").collect()
    assert [(r.gy, r.gx) for r in got] == path and [r.seq for r in got] == list(range(len(path)))
    prints = B.rectangle_offsets(0.08, 0.14, 0.0, 0.1)
    want = {(y + a, x + b) for y, x in path for a, b in prints if ROOM[y + a][x + b] != "#"}
    covered = O.covered(cells_of(spark, ROOM), "coverage_path", 0.08, 0.14, 0.1, (2, 2), "combined", safety=0).where("accessible").collect()
    assert {(r.gy, r.gx) for r in covered} == want
    assert {(r.ty, r.tx): r.visits for r in O.traffic(O.zigzag(centres, 2, step), 4).collect()} == {t: sum((y // 4, x // 4) == t for y, x in path) for t in {(y // 4, x // 4) for y, x in path}}


def test_start_component(spark):
    free = [(0, x) for x in range(12)] + [(5, x) for x in range(5)] + [(9, x) for x in range(20)]
    df = spark.createDataFrame(free, "gy long, gx long")
    for start, row, begin in (((0, 3), 0, (0, 3)), ((5, 2), 9, (9, 2)), ((3, 30), 9, (9, 19))):
        kept, at = O.start_component(df, start)
        assert {r.gy for r in kept.collect()} == {row} and tuple(at.first()) == begin


def test_modes(spark):
    with pytest.raises(ValueError):
        O.covered(cells_of(spark, ROOM), "other", 0.1, 0.1, 0.1)
    assert O.covered(cells_of(spark, ROOM), "inflation", 0.1, 0.1, 0.1).where("accessible").count() > 0
