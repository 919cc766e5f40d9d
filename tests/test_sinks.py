"""Round trips of clouds and maps that several tasks write."""

import os
import random

import pytest
from pyspark.sql import functions as F

from wayfloor.sources import sinks
from wayfloor.sources.clouds import read_cloud
from wayfloor.sources.sinks import read_clouds, read_map, write_cloud, write_map


def test_cloud_round_trip(spark, tmp_path, monkeypatch):
    rng = random.Random(1)
    rows = [(rng.uniform(-9, 9), rng.uniform(-9, 9), float(i), rng.randint(0, 17), i << 33) for i in range(500)]
    df = spark.createDataFrame(rows, "x double, y double, z float, label int, id long").repartition(6)
    folder = str(tmp_path / "cloud")
    write_cloud(df, folder)
    files = [f for f in os.listdir(folder) if f.endswith(".pcd")]
    assert len(files) == 6 and not [f for f in os.listdir(folder) if f.startswith("_job")]
    assert sorted(tuple(r)[:5] for r in read_clouds(spark, folder).collect()) == sorted(rows)
    assert sum(read_cloud(spark, f"{folder}/{f}").count() for f in files) == 500
    write_cloud(df.limit(3), folder, "append")
    assert read_clouds(spark, folder).count() == 503
    write_cloud(df.limit(3), folder)
    assert read_clouds(spark, folder).count() == 3


def test_a_failed_job_leaves_what_was_there(spark, tmp_path):
    folder = str(tmp_path / "cloud")
    good = spark.createDataFrame([(1.0, 2.0, None)], "x double, y double, z double")
    write_cloud(good, folder)
    with pytest.raises(Exception):
        write_cloud(spark.createDataFrame([(1.0, 1), (2.0, None)], "x double, label int"), folder)
    assert len(os.listdir(folder)) == len([f for f in os.listdir(folder) if "_job" not in f])
    (r,) = read_clouds(spark, folder).collect()
    assert (r.x, r.y) == (1.0, 2.0) and r.z != r.z
    with pytest.raises(Exception):
        write_cloud(spark.createDataFrame([("a",)], "x string"), folder)


@pytest.mark.parametrize("width, height", [(7, 1300), (40, 512), (3, 5)])
def test_map_round_trip(spark, tmp_path, width, height):
    rng = random.Random(width)
    cells = {(rng.randrange(height), rng.randrange(width)): rng.choice([0, 205, 254]) for _ in range(900)}
    rows = [(y, x, p) for (y, x), p in cells.items()] + [(-1, 0, 0), (height, 0, 0), (0, width, 0)]
    folder = str(tmp_path / "map")
    write_map(spark.createDataFrame(rows, "gy long, gx long, pixel int").withColumn("band", F.lit("other")).repartition(5), width, height, folder)
    got = {(r.gy, r.gx): r.pixel for r in read_map(spark, folder).collect()}
    assert all(got[c] == p for c, p in cells.items())
    assert all(p == 205 for c, p in got.items() if c not in cells)
    bands = {(height - 1 - y) // sinks.BAND_ROWS for y, _ in cells}
    assert len(got) == sum(min(sinks.BAND_ROWS, height - b * sinks.BAND_ROWS) * width for b in bands)
