import pytest

from wayfloor.operators.planners import PLANNERS, _largest, a_star, coverage_paths, reachable_poses, shortest

ROOMS = ["......#....", "......#....", "...........", "......#....", "..#...#..##", "......#...."]


def cells(rows):
    return {(y, x) for y, row in enumerate(rows) for x, c in enumerate(row) if c == "."}


@pytest.mark.parametrize("name", sorted(PLANNERS))
@pytest.mark.parametrize("rows", [ROOMS, ["."], ["..#..", "#####", "..#.."], ["." * 9] * 7])
def test_path_is_connected_and_covers_the_component(name, rows):
    free = _largest(cells(rows))
    path = PLANNERS[name](free)
    assert set(path) == free
    assert all(abs(a[0] - b[0]) + abs(a[1] - b[1]) == 1 for a, b in zip(path, path[1:]))


def test_walks_are_shortest():
    free = cells(ROOMS)
    for start, goal in [((0, 0), (0, 10)), ((5, 0), (5, 7)), ((2, 3), (2, 3))]:
        a, b = shortest(free, start, goal), a_star(free, start, goal)
        assert len(a) == len(b) and a[0] == b[0] == start and a[-1] == b[-1] == goal
    assert shortest(free, (0, 0), (9, 9)) == [] == a_star(free, (0, 0), (9, 9))


def test_paths_by_map(spark):
    rows = [(m, y, x) for m in (1, 2) for y, x in cells(ROOMS) if m == 1 or x < 6]
    got = coverage_paths(spark.createDataFrame(rows, "map_id long, gy long, gx long"), "spiral").collect()
    for m in (1, 2):
        assert {(r.gy, r.gx) for r in got if r.map_id == m} == {(y, x) for k, y, x in rows if k == m}
    with pytest.raises(ValueError):
        coverage_paths(spark.createDataFrame(rows, "map_id long, gy long, gx long"), "nothing")


def test_poses(spark):
    free = [(1, k, y, x) for k in range(16) for y, x in cells(ROOMS)]
    df = spark.createDataFrame(free, "map_id long, k int, gy long, gx long")
    everything = {(r.gy, r.gx) for r in reachable_poses(df, (0, 0), "holonomic").collect()}
    assert everything == cells(ROOMS) == {(r.gy, r.gx) for r in reachable_poses(df, (0, 0), "differential").collect()}
    narrow = df.where("k IN (0, 8)")  # no room to turn: a differential robot only drives on along its row
    assert {(r.gy, r.gx) for r in reachable_poses(narrow, (2, 3), "differential").collect()} == {(2, x) for x in range(11)}
