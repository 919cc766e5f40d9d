"""How often a query reads the points: for what it needs of all of them, then once for each table of cells."""

import pytest

from wayfloor.functions.fixtures import scan
from wayfloor.plans import catalog, grid_queries, reach_queries, scene_queries, terrain_queries

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def counted(spark):
    """The scan with a counter of the rows that are read of it."""
    read, points = spark.sparkContext.accumulator(0), scan(spark, DIR)

    def count(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    return points.mapInArrow(count, points.schema), read, points.count()


# The extremes and a percentile of few points take two passes; maps, labels and voxels one each.
@pytest.mark.parametrize(
    "name, most",
    {
        "d14_vertical_score": 4, "c7_surface_continuity": 4, "j11_painted_walls": 4, "d9_removal_candidates": 4, "d12_relocated": 4,
        "a19_coverage_counts": 3, "p7_swept_floor": 3, "p7_sweep_stripes": 3, "j6_p4_overlapping_runs": 3,
        "g8_step_height": 3, "c9_ramp_candidates": 3, "g13_terrain_masks": 3, "a8_ramp_height": 3,
        # Their range, their levels, the extremes, the floors, and two tables of cells.
        "d16_d17_level_layers": 7,
    }.items(),
)
def test_points_are_read_once_for_each_table(spark, monkeypatch, counted, name, most):
    points, read, n = counted
    for module in (grid_queries, reach_queries, scene_queries, terrain_queries):
        monkeypatch.setattr(module, "scan", lambda spark, d: points)
    read.value = 0
    catalog.queries()[name](spark, DIR).collect()
    assert 0 < read.value <= most * n
