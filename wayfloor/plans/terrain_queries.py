"""Queries of terrain, sweeps, relocation and colours."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wayfloor.functions.fixtures import scan
from wayfloor.functions.shared import saved
from wayfloor.operators import components as C
from wayfloor.operators import grid as G
from wayfloor.operators import horizontal as H
from wayfloor.operators import levels as L
from wayfloor.operators import maps as M
from wayfloor.operators import points as P
from wayfloor.operators import ramps as R
from wayfloor.operators import relocation as X
from wayfloor.operators import semantic as S
from wayfloor.operators import terrain as T
from wayfloor.operators import vertical as V
from wayfloor.plans.grid_queries import CELLS, HEIGHTS, MASK, MEDIAN, OCC, bin_sql, fill_sql, grad_sql, height_grid, mask_sum, meta_sql, obstacle_grid, scan_facts
from wayfloor.plans.reach_queries import BOTH, NAMES, cc_sql, labels, largest_sql, reach_sql, reached
from wayfloor.plans.registry import query, rounded
from wayfloor.plans.scene_queries import AXIS, DIRS, LEVELS_SQL, RAMPC, RAMPS, RECT, SUB

SMOOTH2 = """sm AS (SELECT md.gy, md.gx, md.w, md.h, CASE WHEN md.z IS NOT NULL THEN m.z END AS z FROM md LEFT JOIN
    (SELECT gy + a.i AS gy, gx + b.i AS gx, sum(exp(-(a.i * a.i + b.i * b.i) / 8e0) * z) / sum(exp(-(a.i * a.i + b.i * b.i) / 8e0)) AS z FROM md, range(-4, 5) a(i), range(-4, 5) b(i) WHERE z IS NOT NULL GROUP BY ALL) m USING (gy, gx))"""


def kept_sql(mask: str, name: str, least: int) -> str:
    return f"{cc_sql(mask, name)}, {name}k AS (SELECT r.gy, unnest(range(r.a, r.b + 1)) AS gx FROM {name}cc c JOIN {name}runs r USING (id) SEMI JOIN (SELECT c.l FROM {name}cc c JOIN {name}runs r USING (id) GROUP BY c.l HAVING sum(r.b - r.a + 1) >= {least}) s ON s.l = c.l)"


DIAMOND = "(SELECT a.i AS dy, b.i AS dx FROM range(-3, 4) a(i), range(-3, 4) b(i) WHERE abs(a.i) + abs(b.i) <= 3) o"
TERRAIN = f"""{HEIGHTS}, {MEDIAN}, {SMOOTH2}, {fill_sql('sm', 4)}, {grad_sql('f3')}, nb AS (SELECT gy + dy AS gy, gx + dx AS gx, z AS q FROM sm, (VALUES (-1, 0), (1, 0), (0, -1), (0, 1)) o(dy, dx) WHERE z IS NOT NULL),
    stp AS (SELECT sm.gy, sm.gx, coalesce(max(abs(z - q)), 0e0) AS step FROM sm LEFT JOIN nb USING (gy, gx) GROUP BY ALL), kn AS (SELECT gy, gx FROM hm WHERE z IS NOT NULL), {kept_sql('kn', 'kn', 20)},
    tr AS (SELECT gy, gx FROM knk SEMI JOIN (SELECT gy, gx FROM sl WHERE slope <= 35) a USING (gy, gx) SEMI JOIN (SELECT gy, gx FROM stp WHERE step <= 25e-2) b USING (gy, gx)), {kept_sql('tr', 'tr', 20)},
    gw AS (SELECT DISTINCT gy + dy AS gy, gx + dx AS gx FROM trk, {DIAMOND}), off AS (SELECT DISTINCT gy + dy AS gy, gx + dx AS gx FROM (SELECT gy, gx FROM cells ANTI JOIN gw USING (gy, gx)) q, {DIAMOND}),
    trav AS (SELECT gy, gx FROM cells SEMI JOIN gw USING (gy, gx) ANTI JOIN off USING (gy, gx) SEMI JOIN knk USING (gy, gx))"""


def terrain(spark, d):
    cells, meta = height_grid(spark, d)
    return T.masks(cells, meta, 0.2)


@query("g13_terrain_masks", f", {TERRAIN} SELECT (SELECT count(*) FROM knk) AS known, (SELECT count(*) FROM trav) AS traversable, (SELECT CAST(sum(gy * 1000 + gx) AS BIGINT) FROM trav) AS where_", recursive=True)
def g13(spark, d):
    m = terrain(spark, d)
    return m.agg(F.count_if("known").alias("known"), F.count_if("traversable").alias("traversable"), F.sum(F.when(F.col("traversable"), F.col("gy") * 1000 + F.col("gx"))).alias("where_"))


@query("g14_traversability_image", f", {TERRAIN} SELECT CASE WHEN t.gy IS NOT NULL AND c.gy > 0 AND c.gx > 0 AND c.gy < h - 1 AND c.gx < w - 1 THEN 254 ELSE 0 END AS pixel, count(*) AS n FROM cells c LEFT JOIN trav t ON t.gy = c.gy AND t.gx = c.gx GROUP BY 1", recursive=True)
def g14(spark, d):
    return T.map_pixels(terrain(spark, d), "traversable").groupBy("pixel").agg(F.count(F.lit(1)).alias("n"))


FAILED = f"{RAMPC}, {AXIS}, {DIRS}, {RAMPS}, bad AS (SELECT component FROM rmp WHERE angle > 5e0)"


@query("j8_d18_failed_ramps", f", {FAILED}, {OCC.replace('anc AS', 'anc5 AS').replace('FROM scan, meta, anc ', 'FROM scan, meta5, anc5 ').replace('meta AS', 'meta5 AS').replace('cells AS', 'cells5 AS').replace('FROM meta)', 'FROM meta5)').replace('FROM cells ', 'FROM cells5 ')}, f AS (SELECT DISTINCT CAST(floor((gy + 5e-1) * 2e-1 / 5e-2) AS BIGINT) AS gy, CAST(floor((gx + 5e-1) * 2e-1 / 5e-2) AS BIGINT) AS gx FROM cand SEMI JOIN bad USING (component)) SELECT count(*) FILTER (occ OR f.gy IS NOT NULL) AS blocked FROM grid g LEFT JOIN f ON f.gy = g.gy AND f.gx = g.gx", recursive=True)
def j8(spark, d):
    """A robot that climbs 5 degrees: the cells of steeper ramps block the map."""
    from wayfloor.plans.scene_queries import sloped

    cells = sloped(spark, d)
    ramps = R.assessed(R.slope_ramps(cells, 0.2).withColumns({"kind": F.lit("ramp"), "height": F.col("rise")}), 5.0, 0.25).select("component", "traversable")
    at = R.slope_candidates(cells, 0.2).join(ramps, "component").select(F.col("gy").alias("row"), F.col("gx").alias("col"), "traversable")
    grid = obstacle_grid(spark, d).select("gy", "gx", F.col("occupied").alias("blocked"))
    return T.blocked_by_ramps(grid, at, 0.2, 0.05).agg(F.count_if("blocked").alias("blocked"))


@query("f19_manual_ramp", f", {OCC}, r(y0, x0, y1, x1, angle) AS (VALUES (10, 20, 14, 29, 1e1), (40, 40, 41, 41, 4e1), (50, 150, 90, 260, 15e0)) SELECT angle, angle <= 35e0 AS traversable, count(*) AS cells, count(*) FILTER (occ) AS occupied, CAST(sum(gy * 1000 + gx) AS BIGINT) AS where_ FROM grid JOIN r ON gy BETWEEN y0 AND y1 AND gx BETWEEN x0 AND x1 GROUP BY 1, 2")
def f19(spark, d):
    """Ramps that a user drew, laid over the map of the scan."""
    r = spark.createDataFrame([(10, 20, 14, 29, 10.0), (40, 40, 41, 41, 40.0), (50, 150, 90, 260, 15.0)], "y0 int, x0 int, y1 int, x1 int, angle double")
    cells = obstacle_grid(spark, d).join(F.broadcast(r), F.col("gy").between(F.col("y0"), F.col("y1")) & F.col("gx").between(F.col("x0"), F.col("x1")))
    return cells.groupBy("angle", (F.col("angle") <= 35.0).alias("traversable")).agg(F.count(F.lit(1)).alias("cells"), F.count_if("occupied").alias("occupied"), F.sum(F.col("gy") * 1000 + F.col("gx")).alias("where_"))


@query(
    "f17_wall_colours",
    f""", w AS (SELECT *, CAST(floor(y / 2e-1) AS BIGINT) AS gy, CAST(floor(x / 2e-1) AS BIGINT) AS gx FROM scan), mask AS (SELECT DISTINCT gy, gx FROM w WHERE label = 1), {cc_sql('mask')}, lab AS (SELECT r.gy, unnest(range(r.a, r.b + 1)) AS gx, c.l AS component FROM cc c JOIN runs r USING (id)),
    f AS (SELECT component FROM lab GROUP BY 1 ORDER BY count(*) DESC, component LIMIT 1), s AS (SELECT component FROM lab GROUP BY 1 ORDER BY count(*) DESC, component LIMIT 3 OFFSET 1)
    SELECT CASE WHEN label <> 1 THEN 140 WHEN f.component IS NOT NULL THEN 80 ELSE 255 END AS r, CASE WHEN label <> 1 THEN 140 WHEN f.component IS NOT NULL THEN 220 WHEN s.component IS NOT NULL THEN 90 ELSE 160 END AS g, CASE WHEN label <> 1 THEN 140 WHEN f.component IS NOT NULL THEN 255 WHEN s.component IS NOT NULL THEN 180 ELSE 0 END AS b, count(*) AS n
    FROM w LEFT JOIN lab USING (gy, gx) LEFT JOIN f USING (component) LEFT JOIN s USING (component) GROUP BY ALL""",
    recursive=True,
)
def f17(spark, d):
    """The largest wall segment in focus, the three next ones selected."""
    points = scan(spark, d)
    cells = C.components(points.where("label = 1").select(P.cell(F.col("y"), 0.2).alias("gy"), P.cell(F.col("x"), 0.2).alias("gx")).distinct())
    best = C.sizes(cells).orderBy(F.desc("n"), "component").limit(4).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "component")))
    return V.wall_colours(points, cells, best.where("rank = 1"), best.where("rank > 1")).groupBy("r", "g", "b").agg(F.count(F.lit(1)).alias("n"))


@query(
    "f21_candidate_filter",
    f", {BOTH}, {NAMES}, obj AS (SELECT label, g.gy, g.gx FROM grid g JOIN lbl USING (gy, gx) JOIN dim USING (label) WHERE occ AND fixation <> 'Fixed'), {cc_sql('obj', 'ob', by='label')}, oc AS (SELECT r.label, c.l AS component, r.gy, unnest(range(r.a, r.b + 1)) AS gx FROM obcc c JOIN obruns r USING (id)) SELECT label, component, count(*) AS cells FROM oc JOIN dim USING (label) WHERE fixation IN ('Movable', 'Portable') GROUP BY label, component HAVING avg(CASE WHEN gx BETWEEN 60 AND 140 THEN 1e0 ELSE 0e0 END) >= 5e-1",
    recursive=True,
)
def f21(spark, d):
    """Movable and portable objects that lie at least half in a rectangle of the map."""
    grid = obstacle_grid(spark, d).select("gy", "gx", F.col("occupied").alias("blocked"))
    dim = S.label_dimension(spark)
    return H.selected_objects(H.removable_objects(grid, labels(spark, d), dim), dim, ["Movable", "Portable"], grid.where("gx BETWEEN 60 AND 140").select("gy", "gx"))


@query("g19_placements", f", {OCC}, f AS (SELECT gy, gx FROM grid WHERE NOT occ), b AS (SELECT gy - a.i AS gy, gx - b.i AS gx FROM f, range(8) a(i), range(12) b(i)), k AS (SELECT gy, gx FROM b GROUP BY ALL HAVING count(*) = 96) SELECT {MASK.format('TRUE')} FROM k SEMI JOIN cells USING (gy, gx)")
def g19(spark, d):
    free = obstacle_grid(spark, d).withColumn("free", ~F.col("occupied"))
    return mask_sum(X.placements(free, 8, 12).withColumn("on", F.lit(True)), "on")


@query("g21_peer_distance", f", {BOTH}, z AS (SELECT gy, gx FROM grid WHERE NOT occ), p AS (SELECT gy AS py, gx AS px FROM lbl WHERE label = 13) SELECT gy, gx, round(least(coalesce(min(sqrt((gy - py) * (gy - py) + (gx - px) * (gx - px)) * 5e-2), 1e0), 1e0), 6) AS distance FROM z LEFT JOIN p ON py BETWEEN gy - 20 AND gy + 20 AND px BETWEEN gx - 20 AND gx + 20 GROUP BY 1, 2", recursive=True)
def g21(spark, d):
    """From every free cell to the nearest cell of movable objects, up to a metre."""
    zones = obstacle_grid(spark, d).where("NOT occupied").select("gy", "gx")
    return rounded(X.peer_distance(zones, labels(spark, d).where("label = 13").select("gy", "gx"), 1.0, 0.05))


@query("d11_ranked_zones")
def d11(spark, d):
    """Places for the largest object of a selected lane that it bars, with the rules as far relaxed as needed."""
    lane, known = F.col("gx").between(8, 60) & F.col("gy").between(22, 34), scan_facts(spark, d)
    cells = saved(obstacle_grid(spark, d, 0.1, known).select("gy", "gx", (F.col("occupied") | ~lane).alias("blocked"), (~F.col("occupied") & lane).alias("floor")))
    named = labels(spark, d, 0.1, known).where(lane)
    objects = saved(H.removable_objects(cells, named, S.label_dimension(spark)))
    first = C.sizes(objects).orderBy(F.desc("n"), "component").limit(1)
    thing = saved(objects.join(F.broadcast(first), "component", "left_semi").select("label", "gy", "gx"))
    peers = named.join(thing.select("label").distinct(), "label", "left_semi").select("gy", "gx")
    zones = X.relocation_zones(cells, thing, 2, 3, 0.1, peers, relax=2)
    return rounded(zones.select("rank", "gy", "gx", "height", "width", "gain", "peer", "distance", "score"))


@query("d12_relocated")
def d12(spark, d):
    """The things of a lane that they bar, moved one after the other to their best places."""
    lane, known = F.col("gx").between(8, 60) & F.col("gy").between(22, 34), scan_facts(spark, d)
    cells = saved(obstacle_grid(spark, d, 0.1, known).select("gy", "gx", (F.col("occupied") | ~lane).alias("blocked"), (~F.col("occupied") & lane).alias("floor")))
    objects = saved(H.removable_objects(cells, labels(spark, d, 0.1, known).where(lane), S.label_dimension(spark)))
    order = [r["component"] for r in C.sizes(objects).orderBy(F.desc("n"), "component").limit(2).collect()]
    _, moves = X.relocate(cells, objects, order, 2, 3, 0.1)
    rows = [(i, int(m["gy"]), int(m["gx"]), int(m["relax"]), float(m["gain"]), float(m["distance"])) for i, m in enumerate(moves)]
    return rounded(spark.createDataFrame(rows, "move long, gy long, gx long, relax long, gain double, distance double"))


@query("d15_manual_relocation", f", {OCC} SELECT count(*) AS n, CAST(sum(gy + 30) AS BIGINT) AS sum_gy, CAST(sum(gx - 60) AS BIGINT) AS sum_gx FROM grid WHERE occ AND gy + 30 BETWEEN 0 AND (SELECT max(gy) FROM grid) AND gx - 60 BETWEEN 0 AND (SELECT max(gx) FROM grid)")
def d15(spark, d):
    df = obstacle_grid(spark, d).where("occupied").join(F.broadcast(G.bounds(scan(spark, d), 0.05, 0.5).select("height", "width")))
    return X.translated(df, 30, -60).agg(F.count(F.lit(1)).alias("n"), F.sum("gy").alias("sum_gy"), F.sum("gx").alias("sum_gx"))


MOVED = f"own AS (SELECT gy, gx FROM lbl SEMI JOIN (SELECT gy, gx FROM grid WHERE occ) o USING (gy, gx) WHERE label = 13), now AS (SELECT gy + 40 AS gy, gx - 30 AS gx FROM own), gmoved AS (SELECT g.gy, g.gx, (occ AND own.gy IS NULL) OR now.gy IS NOT NULL AS occ FROM grid g LEFT JOIN own ON own.gy = g.gy AND own.gx = g.gx LEFT JOIN now ON now.gy = g.gy AND now.gx = g.gx), {reach_sql(4, 6, 'm').replace('FROM grid', 'FROM gmoved')}"


@query(
    "d15_relocation_score",
    f", {BOTH}, {MOVED}, s AS (SELECT 'before' AS state, (SELECT count(*) FROM abig SEMI JOIN (SELECT gy, gx FROM grid WHERE NOT occ) f USING (gy, gx)) AS acc, (SELECT count(*) FROM grid WHERE NOT occ) AS fl UNION ALL SELECT 'after', (SELECT count(*) FROM mbig SEMI JOIN (SELECT gy, gx FROM gmoved WHERE NOT occ) f USING (gy, gx)), (SELECT count(*) FROM gmoved WHERE NOT occ)) SELECT state, round(acc * 25e-4, 6) AS accessible_area, round(fl * 25e-4, 6) AS floor_area, round(100e0 * acc / fl, 6) AS rii FROM s",
    recursive=True,
)
def d15s(spark, d):
    """The score before and after the movable objects are moved by hand."""
    cells = saved(obstacle_grid(spark, d).select("gy", "gx", F.col("occupied").alias("blocked"), (~F.col("occupied")).alias("floor")))
    thing = saved(labels(spark, d).where("label = 13").join(cells.where("blocked").select("gy", "gx"), ["gy", "gx"], "left_semi").select("gy", "gx"))
    score = lambda c, state: M.score(H.reach(c, 4, 6), 0.05).withColumn("state", F.lit(state))
    return rounded(score(cells, "before").unionByName(score(saved(X.relocated(cells, thing, 40, -30)), "after")))


BY_LEVEL = f"""{LEVELS_SQL}, {meta_sql('1e-1')}, {CELLS}, pl AS (SELECT level, x, y, z FROM sl JOIN scan ON z BETWEEN z_low AND z_high), la AS (SELECT level, quantile_cont(z, 5e-2) AS a FROM pl GROUP BY 1),
    lc AS (SELECT level, {bin_sql('1e-1')}, count(*) AS n FROM pl JOIN la USING (level), meta WHERE z BETWEEN a + 5e-2 AND a + 1e0 GROUP BY ALL),
    lg AS (SELECT level, gy, gx, (gy = 0 OR gx = 0 OR gy = h - 1 OR gx = w - 1 OR n IS NOT NULL) AS occ FROM (SELECT level, gy, gx, w, h FROM la, cells) q LEFT JOIN lc USING (level, gy, gx))"""


def level_cells(spark, d, size=0.1):
    return L.level_maps(scan(spark, d), L.levels(scan(spark, d)), size, 0.5).select("level", "gy", "gx", F.col("occupied").alias("blocked"), (~F.col("occupied")).alias("floor"))


@query(
    "a21_building_score",
    f""", {BY_LEVEL}, ldi AS (SELECT DISTINCT level, gy + a.i AS gy, gx + b.i AS gx FROM lg, range(-3, 4) a(i), range(-2, 3) b(i) WHERE occ), lmask AS (SELECT level, gy, gx FROM lg ANTI JOIN ldi USING (level, gy, gx)), {cc_sql('lmask', 'lv', by='level')}, {largest_sql('lv', by='level')},
    l AS (SELECT level, (SELECT count(*) FROM lvbig b WHERE b.level = la.level) * 1e-2 AS actual, (SELECT count(*) FROM lg WHERE lg.level = la.level AND NOT occ) * 1e-2 AS reference FROM la)
    SELECT CAST(level AS VARCHAR) AS level, round(actual, 6) AS actual, round(reference, 6) AS reference, round(100e0 * actual / reference, 6) AS rii, 'complete' AS status FROM l UNION ALL SELECT 'building', round(sum(actual), 6), round(sum(reference), 6), round(100e0 * sum(actual) / sum(reference), 6), 'total' FROM l""",
    recursive=True,
)
def a21(spark, d):
    """The floor that the robot reaches on every level the heights show, and in the building."""
    cells = saved(level_cells(spark, d))
    n = H.reach(cells, 2, 3, "level").groupBy("level").agg((F.count_if("accessible") * 0.01).alias("actual"), (F.count_if("floor") * 0.01).alias("reference"))
    return rounded(M.building_score(n))


@query("d17_points_by_level", f", {BY_LEVEL} SELECT level, count(*) FILTER (occ) AS occupied, count(*) FILTER (NOT occ) AS free FROM lg GROUP BY 1", recursive=True)
def d17(spark, d):
    """The obstacle map of every floor level that the heights show, in one job."""
    n = level_cells(spark, d).groupBy("level").agg(F.count_if("blocked").alias("occupied"), F.count_if("floor").alias("free"))
    return n.select(F.col("level").cast("long").alias("level"), "occupied", "free")


def level_terrain_sql(level: int) -> str:
    """The terrain of one level, in a scope of its own, on cells of two by two of the map's."""
    heights = f"""meta AS (SELECT ox, oy, CAST(ceil(w / 2e0) AS BIGINT) AS w, CAST(ceil(h / 2e0) AS BIGINT) AS h FROM map10), {CELLS}, lp AS (SELECT x, y, z FROM scan, slab WHERE level = {level} AND z BETWEEN z_low AND z_high), anc AS (SELECT quantile_cont(z, 5e-2) AS a FROM lp),
    obs AS (SELECT {bin_sql('2e-1')}, count(*) AS n, quantile_cont(z, 1e-1) AS z FROM lp, meta, anc WHERE z BETWEEN a AND a + 1e0 GROUP BY ALL HAVING count(*) >= 3), hm AS (SELECT c.gy, c.gx, c.w, c.h, o.z FROM cells c LEFT JOIN obs o USING (gy, gx))"""
    return f"(WITH RECURSIVE {TERRAIN.replace(HEIGHTS, heights)} SELECT {level} AS level, k.gy AS ty, k.gx AS tx, t.gy IS NOT NULL AS trav FROM knk k LEFT JOIN trav t USING (gy, gx))"


#: The scan shows two levels; more would have no rows in a third scope.
@query(
    "d16_d17_level_layers",
    f""", {BY_LEVEL}, slab AS MATERIALIZED (SELECT level, z_low, z_high FROM sl), map10 AS (SELECT * FROM meta), tl AS MATERIALIZED ({' UNION ALL '.join('SELECT * FROM ' + level_terrain_sql(i) + f' q{i}' for i in range(3))})
    SELECT lg.level, count(*) FILTER (occ) AS occupied, count(*) FILTER (t.ty IS NOT NULL) AS known, count(*) FILTER (coalesce(trav, FALSE)) AS traversable, count(*) FILTER (coalesce(trav, FALSE) AND NOT occ) AS floor, CAST(coalesce(sum(gy * 1000 + gx) FILTER (coalesce(trav, FALSE) AND NOT occ), 0) AS BIGINT) AS where_
    FROM lg LEFT JOIN tl t ON t.level = lg.level AND t.ty = lg.gy // 2 AND t.tx = lg.gx // 2 GROUP BY 1""",
    recursive=True,
)
def d16(spark, d):
    """Obstacle, terrain and floor layers of every level that the heights show."""
    layers = M.build_levels(scan(spark, d), L.levels(scan(spark, d)), 0.1)
    on = {c: F.count_if(c).alias(c) for c in ("occupied", "known", "traversable", "floor")}
    where = F.coalesce(F.sum(F.when(F.col("floor"), F.col("gy") * 1000 + F.col("gx"))), F.lit(0)).alias("where_")
    return layers.groupBy(F.col("level").cast("long").alias("level")).agg(*on.values(), where)


TILES = "tl AS (SELECT gy // 4 AS gy, gx // 4 AS gx FROM grid GROUP BY ALL HAVING bool_and(NOT occ) AND count(*) = 16)"


@query(
    "p6_spiral_covered_area",
    f", {OCC}, {TILES}, {cc_sql('tl', 'sp')}, s AS (SELECT CAST(sum(r.b - r.a + 1) AS BIGINT) AS n FROM spcc c JOIN spruns r USING (id) GROUP BY c.l) SELECT max(n) AS tiles, max(n) * 16 AS cells, round(max(n) * 16 * 25e-4, 6) AS area FROM s",
    recursive=True,
)
def p6(spark, d):
    from wayfloor.operators import components as C

    tiles = G.tiles(obstacle_grid(spark, d).withColumn("free", ~F.col("occupied")), "free", 4, "all").where("free")
    n = C.largest(C.components(tiles.select(F.col("ty").alias("gy"), F.col("tx").alias("gx")))).agg(F.count(F.lit(1)).alias("tiles"))
    return rounded(n.select("tiles", (F.col("tiles") * 16).alias("cells"), (F.col("tiles") * 16 * 0.0025).alias("area")))


@query("p6_spiral_path")
def p6p(spark, d):
    from wayfloor.operators.planners import coverage_paths

    tiles = G.tiles(obstacle_grid(spark, d).withColumn("free", ~F.col("occupied")), "free", 4, "all").where("free")
    path = coverage_paths(tiles.select(F.lit(0).cast("long").alias("map_id"), F.col("ty").alias("gy"), F.col("tx").alias("gx")), "spiral")
    return path.agg(F.count_distinct("gy", "gx").alias("tiles"), F.count(F.lit(1)).alias("steps"))


ZIGZAG = f"{OCC}, {reach_sql(6, 4, 'a')}, zc AS (SELECT gy, gx, dense_rank() OVER (ORDER BY gy) AS k FROM abig WHERE (gy - (SELECT min(gy) FROM abig)) % 7 = 0)"


def zigzag_path(spark, d):
    """Stripes over the centres at which the body, heading east, is clear."""
    from wayfloor.operators import coverage as V2

    cells = reached(spark, d, 6, 4)
    centres = saved(cells.where("accessible").select("gy", "gx"))
    anchor = centres.agg(F.min("gy")).first()[0]
    return V2.zigzag(centres, anchor, V2.stripe_step(0.2, 0.05)), cells


@query("p7_sweep_stripes", f", {ZIGZAG} SELECT gy, k % 2 = 1 AS forward, count(*) AS cells, min(gx) AS x0, max(gx) AS x1 FROM zc GROUP BY 1, 2", recursive=True)
def p7(spark, d):
    return zigzag_path(spark, d)[0].groupBy("gy", "forward").agg(F.count(F.lit(1)).alias("cells"), F.min("gx").alias("x0"), F.max("gx").alias("x1"))


@query("p7_swept_floor", f", {ZIGZAG}, {SUB}, fp AS (SELECT DISTINCT a.i AS dy, b.i AS dx FROM range(-12, 13) a(i), range(-12, 13) b(i), s p, s q WHERE {RECT.format('0e0')}), sw AS (SELECT DISTINCT gy + dy AS gy, gx + dx AS gx FROM zc, fp), pt AS (SELECT gx, gy, row_number() OVER (ORDER BY k, CASE WHEN k % 2 = 1 THEN gx ELSE -gx END) - 1 AS seq FROM zc) SELECT (SELECT count(*) FROM pt) AS waypoints, (SELECT CAST(sum(seq * gx) AS BIGINT) FROM pt) AS by_gx, (SELECT count(*) FROM sw SEMI JOIN (SELECT gy, gx FROM grid WHERE NOT occ) f USING (gy, gx)) AS swept", recursive=True)
def p7s(spark, d):
    from wayfloor.operators import coverage as V2
    from wayfloor.operators import robots as B

    path, cells = zigzag_path(spark, d)
    swept = V2.stamped(path, B.rectangle_offsets(0.2, 0.3, 0.0, 0.05), cells.where("NOT blocked"))
    return path.agg(F.count(F.lit(1)).alias("waypoints"), F.sum(F.col("seq") * F.col("gx")).alias("by_gx")).join(swept.agg(F.count(F.lit(1)).alias("swept")))


@query("a26_traffic", f", {ZIGZAG} SELECT gy // 4 AS ty, gx // 4 AS tx, count(*) AS visits FROM zc GROUP BY ALL", recursive=True)
def a26(spark, d):
    from wayfloor.operators import coverage as V2

    return V2.traffic(zigzag_path(spark, d)[0], 4)


@query("j5_frames_with_poses", ", f AS (SELECT DISTINCT user_id AS frame FROM events), a AS (SELECT frame, row_number() OVER (ORDER BY frame) AS idx FROM f), p AS (SELECT event_id, row_number() OVER (ORDER BY event_id) AS idx FROM events) SELECT frame, event_id FROM a JOIN p USING (idx)")
def j5(spark, d):
    from wayfloor.streaming.replay import paired_poses

    events = spark.read.parquet(f"{d}/events.parquet")
    return paired_poses(events.select(F.col("user_id").alias("frame")), events.select(F.col("event_id").alias("t"), "event_id")).select("frame", "event_id")


@query("st_event_windows", " SELECT event_type, CAST(time_bucket(INTERVAL '1 hour', ts) AS VARCHAR) AS hour, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def st(spark, d):
    from wayfloor.streaming.replay import event_windows

    w = event_windows(spark.read.parquet(f"{d}/events.parquet"), "1 hour")
    return w.select("event_type", F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("hour"), "n", F.round("total", 4).alias("total"))
