from wayfloor.operators import maps as M
from wayfloor.sources import maps as files
from wayfloor.sources.exports import candidate_rows, validation_bundle
from wayfloor.sources.exports import coverage_colours, load_project, metric_rows, report_lines, save_project, waypoint_lines, waypoints


def test_text_exports(spark):
    path = spark.createDataFrame([(0, 0, 0), (1, 0, 1)], "seq int, gy int, gx int")
    assert [tuple(r) for r in waypoints(path, 1.0, 2.0, 0.5, 4).orderBy("seq").collect()] == [(0, 1.0, 3.5), (1, 1.5, 3.5)]
    assert waypoint_lines(waypoints(path, 1.0, 2.0, 0.5)).first().value == "- {x: 1.0000, y: 2.0000}"
    assert {tuple(r) for r in metric_rows(spark.createDataFrame([(1, 2.5)], "a int, b double")).collect()} == {("a", "1"), ("b", "2.5")}
    ramps = spark.createDataFrame([(7, 5.0, 1.0, 1.0, 0.1), (9, 8.0, 2.0, 1.0, 0.3)], "component long, angle double, length double, width double, rise double")
    assert report_lines(ramps).first().value.startswith("ramp 9: angle 8.0")
    cells = spark.createDataFrame([(0, 0, True, False, False), (0, 1, False, True, True)], "gy int, gx int, blocked boolean, floor boolean, covered boolean")
    assert {tuple(r) for r in coverage_colours(cells).collect()} == {(0, 0, 0, 0, 0), (0, 1, 60, 180, 75)}


def test_project_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "n int, s string")
    save_project(spark, str(tmp_path), {"rii": 81.5}, {"cells": df})
    scalars, tables = load_project(spark, str(tmp_path))
    assert scalars == {"rii": 81.5} and [tuple(r) for r in tables["cells"].collect()] == [(1, "a")]


def test_validation_bundle(spark, tmp_path):
    rows = [(0, 0, True, False, False), (0, 1, False, True, True), (0, 2, False, True, False)]
    act = spark.createDataFrame(rows, "gy int, gx int, blocked boolean, floor boolean, covered boolean")
    ref = act.withColumn("covered", act.floor)
    validation_bundle(str(tmp_path), {"obstacle": act, "reference": ref, "actual": act}, 0.5)
    got = {(r.layer, r.metric): r.value for r in spark.read.option("header", True).csv(str(tmp_path / "summary")).collect()}
    assert got["obstacle", "occupied"] == "1" and got["actual", "uncovered"] == "1" and got["compare", "reference_only"] == "1"
    assert spark.read.parquet(str(tmp_path / "compare")).count() == 3


def test_costmap_eraser_and_paths(spark, tmp_path):
    cells = spark.createDataFrame([(0, x, x == 2) for x in range(6)], "gy long, gx long, blocked boolean")
    assert [r.pixel for r in files.costmap_pixels(cells, 1, 0).orderBy("gx").collect()] == [254, 0, 0, 0, 254, 254]
    kinds = spark.createDataFrame([(y, x, "free") for y in range(5) for x in range(5)], "gy long, gx long, kind string")
    left = M.erased(kinds, spark.createDataFrame([(2, 2, 1.0), (0, 0, 0.5)], "gy long, gx long, radius double"))
    assert {(r.gy, r.gx) for r in left.where("kind = 'unknown'").collect()} == {(2, 2), (1, 2), (3, 2), (2, 1), (2, 3), (0, 0)}
    for n in ("map_level2.pgm", "map_level10.pgm", "map_levelx.pgm", "map.pgm"):
        (tmp_path / n).write_bytes(b"P5\n1 1\n255\n\0")
    assert sorted(r.level for r in files.level_maps(spark, str(tmp_path)).collect()) == [2, 10]
    assert files.first_existing(spark, str(tmp_path), ["none", "map"], [".yaml", ".pgm"]).endswith("/map.pgm")
    assert files.sidecar_paths("a/map.pgm") == {"traversable": "a/map_traversable.pgm", "floor": "a/map_floor.pgm"}
    some = spark.createDataFrame([(1, True), (2, False)], "id int, is_manual boolean")
    assert M.shown_ramps(some, True).count() == 1 and M.shown_ramps(some, False).count() == 2


def test_maps_of_a_cloud(spark):
    """A flat floor with a block: floor is traversable but for the block and the edge of the map."""
    rows = [(x * 0.05, y * 0.05, 0.0) for x in range(60) for y in range(60)] + [(1.5 + 0.05 * i, 1.5, 0.1 * k) for i in range(4) for k in range(1, 8)]
    got = M.build(spark.createDataFrame(rows, "x double, y double, z double")).collect()
    assert sum(r.traversable for r in got) > 2000 and not any(r.traversable and r.occupied for r in got)
    inside = [r for r in got if 39 <= r.gy <= 41 and 40 <= r.gx <= 43]
    assert any(r.occupied for r in inside)
    assert sum(r.known for r in got) > 3000


def test_candidate_rows(spark):
    row = spark.createDataFrame([(1, 13, "Movable", "Movable", 20, 0.05, 0.4)], "rank int, label int, name string, fixation string, cells long, area double, unlock_area double")
    assert candidate_rows(row).first().unlock_area == "0.4"
