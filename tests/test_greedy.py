"""Greedy choices in rounds against the sequential loop."""

import math
import random

import pytest
from pyspark.sql import functions as F

from wayfloor.operators import ramps as R
from wayfloor.operators import relocation as X
from wayfloor.operators.greedy import apart


def plain(rows, radius, manhattan):
    kept = []
    for i, y, x, rank in sorted(rows, key=lambda r: (r[3], r[0])):
        near = (abs(y - b) + abs(x - c) if manhattan else math.sqrt((y - b) ** 2 + (x - c) ** 2) for _, b, c in kept)
        if all(d >= radius for d in near):
            kept.append((i, y, x))
    return sorted(i for i, _, _ in kept)


@pytest.mark.parametrize("manhattan", [False, True])
@pytest.mark.parametrize("local", [0, 10_000])
def test_random_places(spark, manhattan, local):
    rng = random.Random(local + manhattan)
    rows = [(i, float(rng.randint(-40, 40)), float(rng.randint(-30, 30)), rng.randint(0, 20)) for i in range(700)]
    rows += [(1000 + i, 5.0, 5.0, 3) for i in range(60)]
    got = apart(spark.createDataFrame(rows, "id long, y double, x double, rank int"), 6, manhattan, local)
    assert sorted(r.id for r in got.collect()) == plain(rows, 6, manhattan)
    assert apart(spark.createDataFrame(rows, "id long, y double, x double, rank int").limit(0), 6, manhattan, local).count() == 0


def test_clusters_equal_the_sequential_rule(spark):
    rng = random.Random(2)
    rows = []
    for i in range(250):
        x, y = rng.uniform(0, 40), rng.uniform(0, 30)
        rows.append((rng.choice([0, 45, 90]), rng.randint(0, 20) / 2, rng.uniform(0, 9), float(i), 5.0, 0.5, 1.0, 0.9, x, y, x + 1, y))
    schema = "heading int, strip_y double, x0 double, x1 double, angle double, rise double, length double, r2 double, wx0 double, wy0 double, wx1 double, wy1 double"
    got = {r.x1: r.cluster for r in R.radius_clusters(spark.createDataFrame(rows, schema), 5.0).collect()}
    rows.sort(key=lambda r: r[:3])
    cluster = [None] * len(rows)
    for i, a in enumerate(rows):
        if cluster[i] is None:
            for j in range(i, len(rows)):
                b = rows[j]
                if cluster[j] is None and (j == i or math.sqrt((a[8] - b[8]) ** 2 + (a[9] - b[9]) ** 2) < 5.0):
                    cluster[j] = i
    assert got == {r[3]: c for r, c in zip(rows, cluster)}


def test_zones_equal_the_sequential_rule(spark):
    rng = random.Random(3)
    rows = list({(rng.randint(0, 90), rng.randint(0, 120)) for _ in range(900)})
    rows = [(y, x, float(rng.randint(0, 8))) for y, x in rows]
    kept = []
    for y, x, _ in sorted(rows, key=lambda r: (-r[2], r[0], r[1])):
        if len(kept) < X.TRIED and all(abs(y - a) + abs(x - b) >= X.APART for a, b in kept):
            kept.append((y, x))
    got = X._apart(spark.createDataFrame(rows, "gy long, gx long, score double").withColumn("y", F.lit(0))).collect()
    assert [(r.gy, r.gx) for r in sorted(got, key=lambda r: r.zone_id)] == kept and sorted(r.zone_id for r in got) == list(range(len(kept)))
