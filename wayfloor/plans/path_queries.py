"""Queries of poses, which SQL can search in full, and of planners, whose order is sequential: tests hold their invariants."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from wayfloor.functions.shared import saved
from wayfloor.operators import coverage as O
from wayfloor.operators import grid as G
from wayfloor.operators import maps as M
from wayfloor.operators import robots as B
from wayfloor.operators.planners import HEADINGS, MODELS, coverage_paths, pose_moves, reachable_by_model, reachable_poses
from wayfloor.operators.tours import tree_tours
from wayfloor.plans.grid_queries import OCC, obstacle_grid, occupancy_sql
from wayfloor.plans.reach_queries import cc_sql
from wayfloor.plans.registry import query, rounded

TILES = "tl AS (SELECT gy // 4 AS gy, gx // 4 AS gx FROM grid GROUP BY ALL HAVING bool_and(NOT occ) AND count(*) = 16)"
OCC10 = occupancy_sql("1e-1")


def free_tiles(spark, d):
    tiles = G.tiles(obstacle_grid(spark, d).withColumn("free", ~F.col("occupied")), "free", 4, "all").where("free")
    return tiles.select(F.lit(0).cast("long").alias("map_id"), F.col("ty").alias("gy"), F.col("tx").alias("gx"))


def _planner(name, planner):
    @query(name)
    def path(spark, d):
        return coverage_paths(free_tiles(spark, d), planner)

    return path


@query("p1_spanning_tree_path")
def p1(spark, d):
    return tree_tours(free_tiles(spark, d))


@query(
    "p1_spanning_tree_cover",
    f", {OCC}, {TILES}, {cc_sql('tl', 'sp')}, s AS (SELECT c.l, CAST(sum(r.b - r.a + 1) AS BIGINT) AS n FROM spcc c JOIN spruns r USING (id) GROUP BY c.l), m AS (SELECT l, n FROM s ORDER BY n DESC, l LIMIT 1), cs AS (SELECT r.gy, unnest(range(r.a, r.b + 1)) AS gx FROM spcc c JOIN spruns r USING (id) JOIN m USING (l)) SELECT gy, gx, (SELECT n FROM m) AS tiles, 2 * (SELECT n FROM m) - 1 AS visits, 0 AS jumps FROM cs",
    recursive=True,
)
def p1c(spark, d):
    """The tiles that the tour covers, with how long it is and how many of its steps do not lead to a neighbour."""
    path = saved(tree_tours(free_tiles(spark, d)))
    after = path.select("map_id", (F.col("seq") - 1).alias("seq"), F.col("gy").alias("y2"), F.col("gx").alias("x2"))
    step = F.abs(F.col("gy") - F.col("y2")) + F.abs(F.col("gx") - F.col("x2"))
    jumps = path.join(after, ["map_id", "seq"]).agg(F.count_if(step != 1).alias("jumps"))
    n = path.agg(F.count(F.lit(1)).alias("visits"), F.count_distinct("gy", "gx").alias("tiles"))
    return path.select("gy", "gx").distinct().join(F.broadcast(n)).join(F.broadcast(jumps)).select("gy", "gx", "tiles", "visits", F.col("jumps").cast("int").alias("jumps"))


for _name, _planner_name in (("p2_column_sweep_path", "bcd"), ("p3_wavefront_path", "wavefront"), ("p4_column_runs_path", "morse"), ("p5_frontier_path", "frontier")):
    _planner(_name, _planner_name)


def _values(rows) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(map(str, r)) + ")" for r in rows) + ")"


def poses_sql(*models: str) -> str:
    """The search in full: ``op`` the open poses, ``ed`` the edges of every model m, ``seen(m, id)`` what is reached."""
    step = 2 * math.pi / HEADINGS
    body = [(k, y, x) for k in range(HEADINGS) for y, x in B.rectangle_offsets(0.2, 0.3, k * step, 0.1)]
    turn = [(k, y, x) for k in range(HEADINGS) for y, x in B.sweep_offsets(0.2, 0.3, k * step, (k + 1) * step, 0.1)]
    moves = [(m, k, y, x) for m, model in enumerate(models) for k in range(HEADINGS) for y, x in pose_moves(model, k)]
    ids = "({0}.gy * 65536 + {0}.gx) * 16 + {0}.k"
    return f"""{OCC10}, fp(k, dy, dx) AS {_values(body)}, tp(k, dy, dx) AS {_values(turn)}, mv(m, k, dy, dx) AS {_values(moves)},
    gb AS MATERIALIZED (SELECT DISTINCT gy + a.i AS gy, gx + b.i AS gx FROM grid, range(-1, 2) a(i), range(-1, 2) b(i) WHERE occ),
    bl AS MATERIALIZED (SELECT gy, gx FROM gb SEMI JOIN cells USING (gy, gx)),
    bh AS MATERIALIZED (SELECT DISTINCT k, gy - dy AS gy, gx - dx AS gx FROM bl, fp), th AS MATERIALIZED (SELECT DISTINCT k, gy - dy AS gy, gx - dx AS gx, TRUE AS hit FROM bl, tp),
    op AS MATERIALIZED (SELECT k, gy, gx, hit IS NULL AS turn FROM (SELECT unnest(range(16)) AS k, gy, gx FROM cells) q ANTI JOIN bh USING (k, gy, gx) LEFT JOIN th USING (k, gy, gx)),
    sd AS (SELECT gy, gx FROM op ORDER BY abs(gy - 30) + abs(gx - 30), gy, gx LIMIT 1),
    tu AS (SELECT {ids.format('a')} AS s, {ids.format('b')} AS t FROM op a JOIN op b ON b.gy = a.gy AND b.gx = a.gx AND b.k = (a.k + 1) % 16 WHERE a.turn),
    ed AS MATERIALIZED (SELECT m, s, t FROM tu, (SELECT DISTINCT m FROM mv) q UNION SELECT m, t, s FROM tu, (SELECT DISTINCT m FROM mv) q
        UNION SELECT m, {ids.format('a')}, {ids.format('b')} FROM op a JOIN mv ON mv.k = a.k JOIN op b ON b.k = a.k AND b.gy = a.gy + dy AND b.gx = a.gx + dx
            LEFT JOIN op c ON c.k = a.k AND c.gy = a.gy + dy AND c.gx = a.gx LEFT JOIN op e ON e.k = a.k AND e.gy = a.gy AND e.gx = a.gx + dx WHERE dy = 0 OR dx = 0 OR (c.k IS NOT NULL AND e.k IS NOT NULL)),
    seen(m, id) AS (SELECT DISTINCT m, {ids.format('op')} FROM op JOIN sd USING (gy, gx), mv UNION SELECT ed.m, ed.t FROM seen JOIN ed ON ed.m = seen.m AND ed.s = seen.id),
    ps AS MATERIALIZED (SELECT m, id % 16 AS k, id // 16 // 65536 AS gy, id // 16 % 65536 AS gx FROM seen)"""


SWEPT = "sw AS (SELECT DISTINCT gy + dy AS gy, gx + dx AS gx FROM ps JOIN fp USING (k)), fl AS (SELECT gy, gx FROM grid WHERE NOT occ), ac AS (SELECT gy, gx FROM fl SEMI JOIN sw USING (gy, gx))"
AREA = "SELECT round((SELECT count(*) FROM ac) * 1e-2, 6) AS accessible_area, round((SELECT count(*) FROM fl) * 1e-2, 6) AS floor_area, round(100e0 * (SELECT count(*) FROM ac) / (SELECT count(*) FROM fl), 6) AS rii"


@query("c14_c16_swept_poses", f", {poses_sql('combined')}, {SWEPT} SELECT (SELECT count(*) FROM ps) AS poses, (SELECT count(*) FROM (SELECT DISTINCT gy, gx FROM ps) q) AS centres, (SELECT count(*) FROM ac) AS swept", recursive=True)
def c14(spark, d):
    """Poses without collision that are reached from the seed by turns and moves, and the floor their footprints sweep."""
    cells = saved(map_cells(spark, d))
    poses = O.pose_space(cells, 0.2, 0.3, 0.1).withColumn("map_id", F.lit(0).cast("long"))
    seen = saved(reachable_poses(poses, (30, 30), "combined"))
    swept = O.covered(cells, "footprint_fit", 0.2, 0.3, 0.1, (30, 30), "combined").where("accessible")
    return seen.agg(F.count(F.lit(1)).alias("poses"), F.count_distinct("gy", "gx").alias("centres")).join(swept.agg(F.count(F.lit(1)).alias("swept")))


@query("c15_pose_models", f", {poses_sql(*MODELS)} SELECT CASE m WHEN 0 THEN '{MODELS[0]}' WHEN 1 THEN '{MODELS[1]}' WHEN 2 THEN '{MODELS[2]}' ELSE '{MODELS[3]}' END AS model, k, count(*) AS poses, CAST(sum(gy) AS BIGINT) AS sum_gy, CAST(sum(gx) AS BIGINT) AS sum_gx FROM ps GROUP BY 1, 2", recursive=True)
def c15(spark, d):
    """The poses that each motion model reaches, by heading."""
    seen = reachable_by_model(O.pose_space(saved(map_cells(spark, d)), 0.2, 0.3, 0.1), (30, 30))
    n = seen.groupBy("model", F.col("k").cast("long").alias("k")).agg(F.count(F.lit(1)).alias("poses"), F.sum("gy").alias("sum_gy"), F.sum("gx").alias("sum_gx"))
    return n


def map_cells(spark, d):
    return obstacle_grid(spark, d, 0.1).select("gy", "gx", F.col("occupied").alias("blocked"), (~F.col("occupied")).alias("floor"))


@query("d6_footprint_fit", f", {poses_sql('differential')}, {SWEPT} {AREA}", recursive=True)
def d6f(spark, d):
    return rounded(M.score(O.covered(saved(map_cells(spark, d)), "footprint_fit", 0.2, 0.3, 0.1, (30, 30)), 0.1))


ZIGZAGS = f"zr AS (SELECT DISTINCT gy, gx FROM ps WHERE k IN (0, 8) AND (((gy - 30) % {O.stripe_step(0.2, 0.1)}) + {O.stripe_step(0.2, 0.1)}) % {O.stripe_step(0.2, 0.1)} = 0), sw AS (SELECT DISTINCT gy + dy AS gy, gx + dx AS gx FROM zr, fp WHERE k = 0), fl AS (SELECT gy, gx FROM grid WHERE NOT occ), ac AS (SELECT gy, gx FROM fl SEMI JOIN sw USING (gy, gx))"


@query("d6_coverage_path", f", {poses_sql('differential')}, {ZIGZAGS} {AREA}", recursive=True)
def d6c(spark, d):
    return rounded(M.score(O.covered(saved(map_cells(spark, d)), "coverage_path", 0.2, 0.3, 0.1, (30, 30)), 0.1))


@query("a26_spiral_traffic")
def spiral_traffic(spark, d):
    """Visits of the spiral's path to every tile of the component that holds the start."""
    tiles, _ = O.start_component(free_tiles(spark, d), (15, 15))
    path = coverage_paths(tiles.select(F.lit(0).cast("long").alias("map_id"), "gy", "gx"), "spiral")
    return O.traffic(path, 1)
