"""Percentiles by refinement against the built-in aggregate."""

import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from wayfloor.operators.percentiles import by_group, percentile_row, percentiles

SHARES = [0.0, 0.02, 0.05, 0.333, 0.5, 0.95, 1.0]


def values(kind):
    rng = random.Random(kind)
    if kind == "normal":
        return [rng.gauss(0, 1) for _ in range(3000)]
    if kind == "few":
        return [float(rng.choice([1, 1, 1, 2, 5])) for _ in range(2500)]
    if kind == "one":
        return [7.25] * 500
    if kind == "wide":
        return [rng.choice([-1, 1]) * 10.0 ** rng.randint(-300, 307) for _ in range(2000)]
    return [0.1] * 900 + [rng.random() * 1e-9 for _ in range(900)] + [1e9]


@pytest.mark.parametrize("kind", ["normal", "few", "one", "wide", "skewed"])
def test_refinement_is_exact(spark, kind):
    v = values(kind)
    df = spark.createDataFrame([(x,) for x in v] + [(None,)] * 5, "z double").repartition(5)
    want = [float(x) for x in np.quantile(np.array(v), SHARES, method="linear")]
    for bins, fetched in ((4096, 1 << 14), (64, 20), (16, 3)):
        got = percentiles(df, "z", SHARES, direct_rows=0, bins=bins, fetched=fetched)
        assert got == pytest.approx(want, rel=1e-12), (bins, fetched)
    assert percentiles(df, "z", SHARES) == pytest.approx(want, rel=1e-12)


def test_no_values(spark):
    df = spark.createDataFrame([(None,)], "z double")
    assert percentiles(df, "z", [0.5]) is None
    assert percentile_row(df, "z", [0.5]).collect()[0].p is None


def test_origins_are_thinned_evenly(spark):
    from wayfloor.operators.vertical import capped_origins

    for n, most in ((100, 100), (100, 7), (101, 33), (50, 49), (9, 1)):
        df = spark.createDataFrame([(i * 3 + 5, i) for i in range(n)], "oid long, px int").repartition(4)
        assert sorted(r.px for r in capped_origins(df, most).collect()) == sorted({i * n // most for i in range(most)})


def test_percentiles_of_groups_are_of_counted_values(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(300), rng.choice([None, 0.25, 0.5, rng.random()])) for _ in range(6000)]
    df = spark.createDataFrame(rows, "k int, z double")
    found = by_group(df, ["k"], "z", 0.1)
    plain = df.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.percentile("z", F.lit(0.1)).alias("z"))
    assert sorted(found.collect()) == sorted(plain.collect())
    held = df.groupBy("k", "z").count().count()
    assert spark.createDataFrame([(1, 2.0)] * 50, "k int, z double").transform(by_group, ["k"], "z", 0.1).collect() == [(1, 50, 2.0)] and held < len(rows)


def test_rows_of_a_percentile_row_are_read_with_other_aggregates(spark):
    df = spark.createDataFrame([(float(i), -float(i)) for i in range(101)], "z double, x double")
    (r,) = percentile_row(df, "z", [0.05], also=[F.min("x").alias("x0")]).collect()
    assert r.p == [5.0] and r.x0 == -100.0
