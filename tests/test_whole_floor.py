"""Rays of a floor with more tool origins than 60,000, with a few of them at each post: no origin is left out."""

import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from wayfloor.functions.fixtures import SCAN_CTE
from wayfloor.plans import catalog, grid_queries

SIDE = 24.0


def room():
    """Walls around a floor, and posts over low blocks so wide that a ray just meets the post from outside the robot's margin."""
    rng, points = random.Random(4), []
    steps = lambda a, b, step: (a + step * i for i in range(round((b - a) / step) + 1))
    points += [(x, y, 0.0, 0) for x in steps(0.0, SIDE, 0.2) for y in steps(0.0, SIDE, 0.2)]
    for t in steps(0.0, SIDE, 0.05):
        points += [p for z in (0.0, 0.5, 1.0) for p in ((t, 0.0, z, 1), (t, SIDE, z, 1), (0.0, t, z, 1), (SIDE, t, z, 1))]
    for cy in range(3, 22, 3):
        for cx in range(3, 22, 3):
            x, y = cx + rng.random(), cy + rng.random()
            points.append((x, y, 1.43, 1))
            points += [(x + a, y + b, 0.1, 9) for a in steps(-0.75, 0.75, 0.04) for b in steps(-0.65, 0.65, 0.04)]
    return points


@pytest.fixture(scope="module")
def table(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("room") / "room.parquet")
    pq.write_table(pa.table(dict(zip(("x", "y", "z", "label"), map(list, zip(*room()))))), path)
    return path


@pytest.fixture
def ask(spark, monkeypatch, table):
    monkeypatch.setattr(grid_queries, "scan", lambda spark, d: spark.read.parquet(table))
    return lambda name: catalog.queries()[name](spark, "").collect()


@pytest.fixture(scope="module")
def truth(table):
    """Rows of the SQL counterparts over the room."""
    con = duckdb.connect()

    def of(name):
        sql = catalog.oracle_sql()[name]
        assert SCAN_CTE in sql
        return con.sql(sql.replace(SCAN_CTE, f"scan AS (SELECT * FROM '{table}')")).fetchall()

    return {name: of(name) for name in ("d13_ray_hits", "j11_painted_walls")}


def test_rays_leave_from_all_of_the_floor(ask, truth):
    assert sorted(tuple(r) for r in ask("d13_ray_hits")) == sorted(truth["d13_ray_hits"])


def test_walls_are_painted_from_all_of_the_floor(ask, truth):
    assert [tuple(r) for r in ask("j11_painted_walls")] == truth["j11_painted_walls"]


def test_the_score_is_of_all_rays(ask, truth):
    (r,) = ask("d14_vertical_score")
    rays = dict((band, n) for band, n, _ in truth["d13_ray_hits"])
    ((painted, wall),) = truth["j11_painted_walls"]
    assert (r.tcr, r.oe) == pytest.approx((painted / wall, rays[True] / sum(rays.values())), abs=1e-6)


def test_continuity_is_of_all_painted_walls(ask, truth):
    (r,) = ask("c7_surface_continuity")
    assert r.painted == truth["j11_painted_walls"][0][0]
