"""The scan as the queries read it: whole, and with filters that stay above its expressions."""

import contextlib
import io

import pytest

from wayfloor.functions.fixtures import scan
from wayfloor.operators import points as P
from wayfloor.plans import grid_queries, scene_queries

DIR = "/root/testdata/sf0.001"


@pytest.fixture
def labelled_ramp(spark, monkeypatch):
    """Floor of 3 m, a ramp of 3 m that rises 0.6 m and has a label of its own, and a deck, seen as the scan."""
    step = [i / 20 for i in range(160)]
    rows = [(x, y, min(max(x - 3, 0.0), 3.0) * 0.2, 9 if 3 <= x < 6 else 0) for x in step for y in step[:80]]
    cloud = spark.createDataFrame(rows, "x double, y double, z double, label int")
    monkeypatch.setattr(grid_queries, "scan", lambda spark, d: cloud)


def test_slope_ramps_are_of_points_of_every_label(spark, labelled_ramp):
    (r,) = scene_queries.d1(spark, DIR).collect()
    assert 11 < r.angle < 12 and r.length >= r.width > 2.5 and r.rise > 0.5


def test_transitions_are_of_points_of_every_label(spark, labelled_ramp):
    (r,) = scene_queries.d2(spark, DIR).collect()
    assert r.kind == "ramp" and 11 < r.angle < 12 and r.traversable


def test_filters_stay_above_the_expressions_of_the_scan(spark):
    """A filter that is pushed below them repeats the CASE of a column wherever it names it, which is too long to be compiled."""
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        P.z_band(P.finite(scan(spark, DIR)), 0.05, 1.0).explain()
    filters = [line for line in out.getvalue().splitlines() if "Filter" in line.split("(")[0]]
    assert filters and not any("CASE" in line for line in filters)
