"""Queries of levels, ramps, walls, joins and map merging."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from wayfloor.functions.fixtures import scan
from wayfloor.functions.shared import saved
from wayfloor.operators import components as C
from wayfloor.operators import grid as G
from wayfloor.operators import levels as L
from wayfloor.operators import maps as M
from wayfloor.operators import points as P
from wayfloor.operators import ramps as R
from wayfloor.operators import robots as B
from wayfloor.operators import vertical as V
from wayfloor.plans.grid_queries import HEIGHTS, MASK, OCC, fill_sql, grad_sql, height_grid, mask_sum, obstacle_grid, scan_facts
from wayfloor.plans.reach_queries import PITCH, cc_sql, reach_sql, reached
from wayfloor.plans.registry import query, rounded

HIST = """r AS (SELECT min(z) AS z0, max(z) AS z1, greatest(8, CAST(ceil((max(z) - min(z)) / 1e-1) AS BIGINT)) AS bins FROM scan), rs AS (SELECT *, (z1 - z0) / bins AS size FROM r),
    hn AS (SELECT least(CAST(floor((z - z0) / size) AS BIGINT), bins - 1) AS bin, count(*) AS n FROM scan, rs GROUP BY 1), hb AS (SELECT b.bin, coalesce(n, 0) AS n, z0 + b.bin * size AS low, size FROM (SELECT unnest(range(bins)) AS bin, z0, size FROM rs) b LEFT JOIN hn USING (bin)),
    hs AS (SELECT *, sum(n) OVER (ORDER BY bin ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) / 3e0 AS s FROM hb),
    hp AS (SELECT bin, s, low + size / 2 AS anchor FROM (SELECT *, coalesce(lag(s) OVER (ORDER BY bin), 0e0) AS l, coalesce(lead(s) OVER (ORDER BY bin), 0e0) AS rr, max(s) OVER () AS top FROM hs) q WHERE s >= l AND s >= rr AND (s > l OR s > rr) AND s >= 15e-2 * top)"""


@query("a11_z_histogram", f", {HIST} SELECT bin, n, round(low, 6) + 0e0 AS low FROM hb")
def a11(spark, d):
    return rounded(L.histogram(scan(spark, d)).select("bin", "n", "low"))


@query("w1_moving_average", f", {HIST} SELECT bin, round(s, 6) AS s FROM hs")
def w1(spark, d):
    return rounded(L.smoothed(L.histogram(scan(spark, d))).select("bin", "s"))


@query("w2_local_maxima", f", {HIST} SELECT bin, round(s, 6) AS s, round(anchor, 6) + 0e0 AS anchor FROM hp")
def w2(spark, d):
    return rounded(L.peaks(L.smoothed(L.histogram(scan(spark, d)))))


LEVELS_SQL = f"""{HIST}, op AS (SELECT row_number() OVER (ORDER BY anchor) AS i, anchor, s FROM hp), mg(i, kept) AS (SELECT 0::BIGINT, []::STRUCT(anchor DOUBLE, s DOUBLE)[] UNION ALL
    SELECT o.i, CASE WHEN len(kept) = 0 OR o.anchor - kept[-1].anchor >= 18e-1 THEN list_append(kept, {{'anchor': o.anchor, 's': o.s}}) WHEN o.s > kept[-1].s THEN list_append(kept[:-2], {{'anchor': o.anchor, 's': o.s}}) ELSE kept END FROM mg JOIN op o ON o.i = mg.i + 1),
    k AS (SELECT unnest(kept).anchor AS anchor FROM (SELECT kept FROM mg ORDER BY i DESC LIMIT 1) q), sl AS (SELECT row_number() OVER (ORDER BY anchor) - 1 AS level, anchor, coalesce((anchor + lag(anchor) OVER (ORDER BY anchor)) / 2, z0) AS z_low, coalesce((anchor + lead(anchor) OVER (ORDER BY anchor)) / 2, least(z1, anchor + 3e0)) AS z_high FROM k, r)"""


@query("w3_d4_floor_levels", f", {LEVELS_SQL} SELECT level, round(anchor, 6) + 0e0 AS anchor, round(z_low, 6) + 0e0 AS z_low, round(z_high, 6) + 0e0 AS z_high, count(*) AS n FROM sl JOIN scan ON z BETWEEN z_low AND z_high GROUP BY ALL", recursive=True)
def d4(spark, d):
    return rounded(L.levels(scan(spark, d)))


@query("a22_line_fit", f", {HEIGHTS} SELECT gy, count(*) AS n, round(regr_slope(z, gx * 2e-1), 9) + 0e0 AS slope, round(regr_intercept(z, gx * 2e-1), 9) + 0e0 AS intercept, round(CASE WHEN var_pop(z) < 1e-12 THEN 1e0 ELSE regr_r2(z, gx * 2e-1) END, 9) AS r2 FROM hm WHERE z IS NOT NULL GROUP BY gy HAVING count(*) >= 3")
def a22(spark, d):
    cells = height_grid(spark, d)[0].where("z IS NOT NULL").withColumn("x", F.col("gx") * 0.2)
    return rounded(R.line_fit(cells, ["gy"]).where("n >= 3"), 9)


RAMPC = f"""{HEIGHTS}, {fill_sql('hm', 4)}, {grad_sql('f3')}, mask AS (SELECT gy, gx FROM sl WHERE slope >= 5e0 AND slope <= 6e1), {cc_sql('mask')},
    lab AS (SELECT r.gy, unnest(range(r.a, r.b + 1)) AS gx, c.l FROM cc c JOIN runs r USING (id)), keep AS (SELECT l FROM lab GROUP BY l HAVING count(*) >= 24), cand AS (SELECT lab.l AS component, sl.* FROM lab JOIN keep USING (l) JOIN sl USING (gy, gx))"""


def sloped(spark, d):
    cells, meta = height_grid(spark, d)
    return saved(G.gradients(G.fill_holes(cells, 4, meta), 0.2), "slopes")


@query("c9_ramp_candidates", f", {RAMPC} SELECT component, count(*) AS n FROM cand GROUP BY 1", recursive=True)
def c9(spark, d):
    return C.sizes(R.slope_candidates(sloped(spark, d), 0.2))


AXIS = """m AS (SELECT component, 5e-1 * atan2(2 * covar_pop(gx, gy), var_pop(gx) - var_pop(gy)) AS th FROM cand GROUP BY 1),
    ext AS (SELECT component, count(*) AS cells, greatest((max(gx * cos(th) + gy * sin(th)) - min(gx * cos(th) + gy * sin(th))) * 2e-1, 2e-1) AS length, greatest((max(gy * cos(th) - gx * sin(th)) - min(gy * cos(th) - gx * sin(th))) * 2e-1, 2e-1) AS width FROM cand JOIN m USING (component) GROUP BY 1)"""
DIRS = "dirs AS (SELECT component, CASE WHEN count(*) >= 3 THEN sqrt(avg(dzdx / g) ** 2 + avg(dzdy / g) ** 2) ELSE 0e0 END AS consistency FROM (SELECT component, dzdx, dzdy, sqrt(dzdx * dzdx + dzdy * dzdy) AS g FROM cand) q WHERE g > 1e-8 GROUP BY 1)"


@query("a23_principal_extent", f", {RAMPC}, {AXIS} SELECT component, cells, round(length, 6) AS length, round(width, 6) AS width FROM ext", recursive=True)
def a23(spark, d):
    return rounded(R.principal_extent(R.slope_candidates(sloped(spark, d), 0.2), ["component"], 0.2))


@query("a24_direction_consistency", f", {RAMPC}, {DIRS} SELECT component, round(consistency, 6) AS consistency FROM dirs", recursive=True)
def a24(spark, d):
    return rounded(R.direction_consistency(R.slope_candidates(sloped(spark, d), 0.2), ["component"]))


RAMPS = "st AS (SELECT component, median(slope) AS angle, max(z) - min(z) AS rise FROM cand GROUP BY 1), rmp AS (SELECT *, cells * 2e-1 * 2e-1 AS area FROM ext JOIN dirs USING (component) JOIN st USING (component) WHERE length >= 1 AND width >= 5e-1 AND cells * 2e-1 * 2e-1 >= 1 AND consistency >= CASE WHEN cells * 2e-1 * 2e-1 > 5 THEN 4e-1 ELSE 6e-1 END AND rise >= 15e-2)"


@query("d1_slope_ramps", f", {RAMPC}, {AXIS}, {DIRS}, {RAMPS} SELECT component, cells, round(length, 6) AS length, round(width, 6) AS width, round(consistency, 6) AS consistency, round(angle, 6) AS angle, round(rise, 6) AS rise, round(area, 6) AS area FROM rmp", recursive=True)
def d1(spark, d):
    """The ramps of the scan, of all its points."""
    return rounded(R.slope_ramps(sloped(spark, d), 0.2))


STEPS = f"nb AS (SELECT gy + dy AS gy, gx + dx AS gx, z AS q FROM hm, (VALUES (-1, 0), (1, 0), (0, -1), (0, 1)) o(dy, dx) WHERE z IS NOT NULL), stp AS (SELECT gy, gx, max(abs(z - q)) AS step FROM hm JOIN nb USING (gy, gx) WHERE z IS NOT NULL GROUP BY ALL HAVING max(abs(z - q)) >= 15e-2), {cc_sql('stp', 'sp')}, sc AS (SELECT c.l AS component, r.gy, unnest(range(r.a, r.b + 1)) AS gx FROM spcc c JOIN spruns r USING (id))"


@query("d2_assessed_transitions", f", {RAMPC}, {AXIS}, {DIRS}, {RAMPS}, {STEPS}, t AS (SELECT 'ramp' AS kind, component, angle, rise AS height FROM rmp UNION ALL SELECT 'step', component, NULL, max(step) FROM sc JOIN stp USING (gy, gx) GROUP BY component) SELECT kind, component, round(angle, 6) AS angle, round(height, 6) AS height, CASE kind WHEN 'ramp' THEN angle <= 35e0 WHEN 'step' THEN height <= 25e-2 ELSE FALSE END AS traversable FROM t", recursive=True)
def d2(spark, d):
    """The ramps of the scan by their angle, and components of cells with a step by the highest."""
    ramps = R.slope_ramps(sloped(spark, d), 0.2).select(F.lit("ramp").alias("kind"), "component", "angle", F.col("rise").alias("height"))
    cells = saved(G.step_height(height_grid(spark, d)[0]).where("z IS NOT NULL AND step >= 0.15"))
    steps = C.components(cells.select("gy", "gx")).join(cells.select("gy", "gx", "step"), ["gy", "gx"]).groupBy("component").agg(F.max("step").alias("height"))
    found = ramps.unionByName(steps.select(F.lit("step").alias("kind"), "component", F.lit(None).cast("double").alias("angle"), "height"))
    return rounded(R.assessed(found, 35.0, 0.25))


PROF = """anc AS (SELECT quantile_cont(z, 5e-2) AS a FROM scan), pk AS (SELECT x, z, CAST(floor(y / 5e-1) AS BIGINT) AS strip FROM scan, anc WHERE z BETWEEN a AND a + 15e-1), p0 AS (SELECT strip, min(x) AS x0 FROM pk GROUP BY 1 HAVING count(*) >= 10),
    pb AS (SELECT strip, CAST(floor((x - x0) / 2e-1) AS BIGINT) AS bin, x0, quantile_cont(z, 1e-1) AS z FROM pk JOIN p0 USING (strip) GROUP BY ALL HAVING count(*) >= 3), prof AS (SELECT strip, bin, x0 + (bin + 5e-1) * 2e-1 AS x, z FROM pb QUALIFY count(*) OVER (PARTITION BY strip) >= 5)"""


def band(spark, d):
    df = scan(spark, d)
    p = P.floor_preset(df).select("anchor")
    return df.join(F.broadcast(p)).where(F.col("z").between(F.col("anchor"), F.col("anchor") + 1.5)).select("x", "y", "z")


@query("w7_profiles", f", {PROF} SELECT strip, bin, round(x, 6) + 0e0 AS x, round(z, 6) + 0e0 AS z FROM prof")
def w7(spark, d):
    return rounded(R.profiles(band(spark, d)))


@query("w4_greedy_segments")
def w4(spark, d):
    return rounded(R.greedy_segments(R.profiles(band(spark, d))))


@query("w9_d3_profile_ramps")
def w9(spark, d):
    """Ramps from cross-sections along four headings, with their angles refined."""
    ramps = R.section_ramps(band(spark, d)).withColumnRenamed("cluster", "ramp")
    return rounded(R.refined_angles(ramps, band(spark, d)).drop("r2"))


VOX = """o AS (SELECT min(x) - 1e-1 AS ox, min(y) - 1e-1 AS oy, min(z) - 1e-1 AS oz, quantile_cont(z, 5e-2) AS fl FROM scan),
    vx AS (SELECT CAST(floor((x - ox) / 1e-1) AS BIGINT) AS vx, CAST(floor((y - oy) / 1e-1) AS BIGINT) AS vy, CAST(floor((z - oz) / 1e-1) AS BIGINT) AS vz, count(*) AS n, count(*) FILTER (label = 1) * 1e0 / count(*) >= 6e-1 AS wall FROM scan, o GROUP BY ALL),
    vox AS (SELECT vx.*, wall AND oz + (vz + 5e-1) * 1e-1 BETWEEN fl + 4e-1 AND fl + 2e0 AS in_band FROM vx, o)"""


@query("a16_wall_voxels", f", {VOX} SELECT vx, vy, vz, n, wall, in_band FROM vox")
def a16(spark, d):
    return V.wall_voxels(scan(spark, d), 0.1)


ORIGINS = f"""{OCC}, {reach_sql(4, 6, 'a')}, og AS (SELECT (gy * {PITCH} + gx) * 64 + hh.i AS oid, (m.ox + (gx + 5e-1) * 5e-2 - o.ox) / 1e-1 AS px, (m.oy + (gy + 5e-1) * 5e-2 - o.oy) / 1e-1 AS py, CAST(floor((o.fl + 4e-1 + hh.i * 2e-1 - o.oz) / 1e-1) AS BIGINT) AS vz FROM abig SEMI JOIN (SELECT gy, gx FROM grid WHERE NOT occ) fl USING (gy, gx), meta m, o, range(9) hh(i) WHERE gy % 3 = 0 AND gx % 3 = 0),
    rays AS (SELECT k, cos(radians(k * 10e0)) AS dx, sin(radians(k * 10e0)) AS dy FROM range(36) r(k))"""
# An independent way to the same voxels: points just before and after every crossing, by their cell.
RAYS = f"""{VOX}, {ORIGINS}, fan AS (SELECT * FROM og, rays), cr AS (
    SELECT oid, k, vz, px, py, dx, dy, 0e0 AS t FROM fan UNION ALL
    SELECT oid, k, vz, px, py, dx, dy, (CASE WHEN dx > 0 THEN floor(px) + 1 - px ELSE px - floor(px) END + i) / abs(dx) FROM fan, range(12) r(i) WHERE abs(dx) > 1e-12 UNION ALL
    SELECT oid, k, vz, px, py, dx, dy, (CASE WHEN dy > 0 THEN floor(py) + 1 - py ELSE py - floor(py) END + i) / abs(dy) FROM fan, range(12) r(i) WHERE abs(dy) > 1e-12),
    cells_ AS (SELECT oid, k, vz, t, CAST(floor(px + (t + 1e-7) * dx) AS BIGINT) AS vx, CAST(floor(py + (t + 1e-7) * dy) AS BIGINT) AS vy FROM cr WHERE t * 1e-1 <= 1e0 + 1e-6),
    met AS (SELECT c.oid, c.k, c.vz, arg_min({{'hx': c.vx, 'hy': c.vy, 'b': v.in_band}}, c.t) AS h FROM cells_ c JOIN vox v USING (vx, vy, vz) GROUP BY ALL), hits AS (SELECT oid, k, vz, h.hx AS hx, h.hy AS hy, h.b AS in_band FROM met)"""


def hits(spark, d):
    """First voxels of the rays from the floor that the robot reaches, at every tool height; the voxels, and the floor.

    The points are read for their extremes and percentiles, for the map and for the voxels, all of which are written.
    """
    points, facts = known = scan_facts(spark, d)
    at = V.corner_of(facts.select("*", F.col("p")[1].alias("floor")), 0.1)
    cells = saved(reached(spark, d, 4, 6, obstacle_grid(spark, d, known=known)))
    floor = cells.where("accessible").select("gy", "gx")
    o = saved(V.tool_origins(floor, G.geometry(facts, 0.05, 0.5), points, 0.05, 0.1, at=at))
    voxels = saved(V.wall_voxels(points, 0.1, at=at))
    return saved(V.first_hits(o, voxels, 0.1)), voxels, cells


@query("d13_ray_hits", f", {RAYS} SELECT in_band, count(*) AS rays, count(DISTINCT oid) AS origins FROM hits GROUP BY 1", recursive=True)
def d13(spark, d):
    return hits(spark, d)[0].groupBy("in_band").agg(F.count(F.lit(1)).alias("rays"), F.count_distinct("oid").alias("origins"))


@query("j11_painted_walls", f", {RAYS}, box AS (SELECT DISTINCT hx + a.i AS vx, hy + b.i AS vy, vz + c.i AS vz FROM hits, range(-2, 3) a(i), range(-2, 3) b(i), range(-2, 3) c(i) WHERE in_band) SELECT (SELECT count(*) FROM vox SEMI JOIN box USING (vx, vy, vz) WHERE in_band) AS painted, (SELECT count(*) FROM vox WHERE in_band) AS wall", recursive=True)
def j11(spark, d):
    h, voxels, _ = hits(spark, d)
    n = V.painted(h, voxels, 0.1).agg(F.count(F.lit(1)).alias("painted"))
    return n.join(voxels.agg(F.count_if("in_band").alias("wall")))


@query("c7_surface_continuity")
def c7(spark, d):
    h, voxels, _ = hits(spark, d)
    return V.continuity(V.painted(h, voxels, 0.1))


@query("d14_vertical_score")
def d14(spark, d):
    """The combined score of the scan: reached floor, painted wall, rays that met wall rather than obstacles, continuity."""
    h, voxels, cells = hits(spark, d)
    done = saved(V.painted(h, voxels, 0.1))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    parts = done.agg(F.count(F.lit(1)).alias("painted")).join(voxels.agg(F.count_if("in_band").alias("wall"))).join(V.continuity(done).select("largest"))
    parts = parts.join(h.agg(F.count_if("in_band").alias("met"), F.count(F.lit(1)).alias("rays"))).join(M.score(cells, 0.05).select("rii"))
    n = F.col
    scores = parts.select(n("rii").alias("rii_h"), share(n("painted"), n("wall")).alias("tcr"), share(n("met"), n("rays")).alias("oe"), share(n("largest"), n("painted")).alias("sc"))
    return rounded(M.combined(scores))


@query(
    "c8_a25_wall_segments",
    f""", w AS (SELECT x, y, z, CAST(floor(y / 2e-1) AS BIGINT) AS gy, CAST(floor(x / 2e-1) AS BIGINT) AS gx FROM scan WHERE label = 1), mask AS (SELECT DISTINCT gy, gx FROM w), {cc_sql('mask')}, lab AS (SELECT r.gy, unnest(range(r.a, r.b + 1)) AS gx, c.l AS component FROM cc c JOIN runs r USING (id))
    SELECT component, count(DISTINCT gy * {PITCH} + gx) AS cells, count(*) AS points, round(avg(x), 4) AS cx, round(avg(y), 4) AS cy, round(min(z), 4) AS z_min, round(max(z), 4) AS z_max, round(count(DISTINCT gy * {PITCH} + gx) * 4e-2, 6) AS area FROM w JOIN lab USING (gy, gx) GROUP BY 1 HAVING count(DISTINCT gy * {PITCH} + gx) * 2e-1 * 2e-1 >= 5e-1""",
    recursive=True,
)
def a25(spark, d):
    s = V.wall_segments(scan(spark, d))
    return s.select("component", "cells", "points", *(F.round(c, 4).alias(c) for c in ("cx", "cy", "z_min", "z_max")), F.round("area", 6).alias("area"))


@query("j4_nearest_cell", f", {OCC} SELECT q.id, arg_min(gy, (abs(gy - q.y) + abs(gx - q.x)) * 1e9 + gy * 1e4 + gx) AS gy, arg_min(gx, (abs(gy - q.y) + abs(gx - q.x)) * 1e9 + gy * 1e4 + gx) AS gx FROM grid, (VALUES (1, 0, 0), (2, 70, 110), (3, 139, 40)) q(id, y, x) WHERE NOT occ GROUP BY q.id")
def j4(spark, d):
    q = F.broadcast(spark.createDataFrame([(1, 0, 0), (2, 70, 110), (3, 139, 40)], "id int, y int, x int"))
    far = F.abs(F.col("gy") - F.col("y")) + F.abs(F.col("gx") - F.col("x"))
    best = obstacle_grid(spark, d).where("NOT occupied").join(q).groupBy("id").agg(F.min(F.struct(far.alias("d"), "gy", "gx")).alias("m"))
    return best.select("id", "m.gy", "m.gx")


COLS = "cr AS (SELECT gx, min(gy) AS r0, max(gy) AS r1 FROM (SELECT gx, gy, gy - row_number() OVER (PARTITION BY gx ORDER BY gy) AS g FROM grid WHERE NOT occ) q GROUP BY gx, g)"


@query("w6_vertical_runs", f", {OCC}, {COLS} SELECT gx, r0, r1 FROM cr")
def w6(spark, d):
    return vertical_runs(spark, d)


def vertical_runs(spark, d):
    free = obstacle_grid(spark, d).where("NOT occupied").select("gx", "gy")
    return C.runs(free, ["gx"], "gy").select("gx", F.col("a").alias("r0"), F.col("b").alias("r1"))


@query("j6_p4_overlapping_runs", f", {OCC}, {COLS} SELECT p.gx, p.r0, q.r0 AS r0_next FROM cr p JOIN cr q ON q.gx = p.gx + 1 AND p.r1 >= q.r0 AND q.r1 >= p.r0")
def j6(spark, d):
    r = vertical_runs(spark, d)
    q = r.select(F.col("gx").alias("gx2"), F.col("r0").alias("r0_next"), F.col("r1").alias("r1_next"))
    return r.join(q, (F.col("gx2") == F.col("gx") + 1) & (F.col("r1") >= F.col("r0_next")) & (F.col("r1_next") >= F.col("r0"))).select("gx", "r0", "r0_next")


@query("p2_column_sweep", f", {OCC}, c AS (SELECT gy, gx, row_number() OVER (ORDER BY gx, CASE WHEN gx % 2 = 0 THEN gy ELSE -gy END) AS seq FROM grid WHERE NOT occ) SELECT count(*) AS n, CAST(sum(seq * gy) AS BIGINT) AS by_gy, CAST(sum(seq * gx) AS BIGINT) AS by_gx FROM c")
def p2(spark, d):
    free = obstacle_grid(spark, d).where("NOT occupied").select("gy", "gx")
    # Numbers inside a column, and the cells of the columns before: no sort of the whole map in one task.
    inside = F.row_number().over(Window.partitionBy("gx").orderBy(F.when(F.col("gx") % 2 == 0, F.col("gy")).otherwise(-F.col("gy"))))
    counts = free.groupBy("gx").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("gx").rowsBetween(Window.unboundedPreceding, -1)))
    way = free.withColumn("i", inside).join(counts.select("gx", F.coalesce("before", F.lit(0)).alias("before")), "gx").withColumn("seq", F.col("i") + F.col("before"))
    return way.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("seq") * F.col("gy")).alias("by_gy"), F.sum(F.col("seq") * F.col("gx")).alias("by_gx"))


def grown_sql(offsets: str) -> str:
    """The occupied cells of the map, grown by the offsets ``c(dy, dx)``."""
    return f"{OCC}, {offsets}, o AS (SELECT DISTINCT gy + dy AS gy, gx + dx AS gx FROM grid, c WHERE occ) SELECT {MASK.format('TRUE')} FROM o SEMI JOIN cells USING (gy, gx)"


def grown(spark, d, offsets):
    df = obstacle_grid(spark, d)
    on = G.dilate(df.where("occupied").select("gy", "gx"), offsets).join(df.select("gy", "gx"), ["gy", "gx"], "left_semi")
    return mask_sum(on.withColumn("on", F.lit(True)), "on")


@query("g16_circle_footprint", f", {grown_sql('c AS (SELECT a.i AS dy, b.i AS dx FROM range(-10, 11) a(i), range(-10, 11) b(i) WHERE (a.i * a.i + b.i * b.i) * 5e-2 * 5e-2 <= (2e-1 + 25e-3) * (2e-1 + 25e-3))')}")
def g16(spark, d):
    """Where a round body would touch what is occupied."""
    return grown(spark, d, B.circle_offsets(0.2, 0.05))


SUB = "s(o) AS (VALUES (1e0 / 6 - 5e-1), (0e0), (5e0 / 6 - 5e-1))"
RECT = "abs((b.i + q.o) * 5e-2 * cos({0}) + (a.i + p.o) * 5e-2 * sin({0})) <= 3e-1 + 1e-9 AND abs((a.i + p.o) * 5e-2 * cos({0}) - (b.i + q.o) * 5e-2 * sin({0})) <= 2e-1 + 1e-9"


@query("g16_rectangle_footprint", f", {SUB}, {grown_sql('c AS (SELECT DISTINCT a.i AS dy, b.i AS dx FROM range(-12, 13) a(i), range(-12, 13) b(i), s p, s q WHERE ' + RECT.format('radians(225e-1)') + ')')}")
def g16r(spark, d):
    """Where a turned rectangle would touch what is occupied."""
    return grown(spark, d, B.rectangle_offsets(0.2, 0.3, math.radians(22.5), 0.05))


@query("g17_rotation_sweep", f", {SUB}, th AS (SELECT radians(225e-1 * k / 4) AS t FROM range(5) r(k)), {grown_sql('c AS (SELECT DISTINCT a.i AS dy, b.i AS dx FROM range(-12, 13) a(i), range(-12, 13) b(i), s p, s q, th WHERE ' + RECT.format('t') + ')')}")
def g17(spark, d):
    """Where a rectangle would touch what is occupied while it turns."""
    return grown(spark, d, B.sweep_offsets(0.2, 0.3, 0.0, math.radians(22.5), 0.05))


@query(
    "g18_collision_cube",
    f", {OCC}, {SUB}, th AS (SELECT k, radians(k * 225e-1) AS t FROM range(16) r(k)), fp AS (SELECT DISTINCT k, a.i AS dy, b.i AS dx FROM range(-12, 13) a(i), range(-12, 13) b(i), s p, s q, th WHERE {RECT.format('t')}), hit AS (SELECT DISTINCT k, gy + dy AS gy, gx + dx AS gx FROM grid, fp WHERE occ) SELECT k, count(*) AS blocked FROM hit SEMI JOIN cells USING (gy, gx) GROUP BY k",
)
def g18(spark, d):
    import math

    grid = obstacle_grid(spark, d)
    rows = [(k, y, x) for k in range(16) for y, x in B.rectangle_offsets(0.2, 0.3, math.radians(22.5 * k), 0.05)]
    prints = F.broadcast(spark.createDataFrame(rows, "k int, dy int, dx int"))
    hit = grid.where("occupied").join(prints).select("k", (F.col("gy") + F.col("dy")).alias("gy"), (F.col("gx") + F.col("dx")).alias("gx")).distinct()
    return hit.join(grid.select("gy", "gx"), ["gy", "gx"], "left_semi").groupBy("k").agg(F.count(F.lit(1)).alias("blocked"))


@query(
    "g20_walls_and_doorways",
    f", {OCC}, nb AS (SELECT g.gy + a.i AS gy, g.gx + b.i AS gx, abs(a.i) + abs(b.i) = 1 AS four, occ FROM grid g, range(-1, 2) a(i), range(-1, 2) b(i) WHERE abs(a.i) + abs(b.i) > 0), c AS (SELECT g.gy, g.gx, g.occ, count(*) FILTER (n.occ) AS walls, count(*) FILTER (n.four AND NOT n.occ) AS open FROM grid g LEFT JOIN nb n USING (gy, gx) GROUP BY ALL) SELECT CAST(sum(walls) FILTER (NOT occ) AS BIGINT) AS wall_sum, count(*) FILTER (NOT occ AND open <= 2) AS doorways FROM c",
)
def g20(spark, d):
    grid = obstacle_grid(spark, d).withColumn("v", F.col("occupied").cast("int"))
    near = G.gathered(grid, "v", [s for s in G.SQUARE if s != (0, 0)])
    four = F.abs("dy") + F.abs("dx") == 1
    n = near.groupBy("gy", "gx").agg(F.count_if(F.col("near") == 1).alias("walls"), F.count_if(four & (F.col("near") == 0)).alias("open"))
    free = grid.where("NOT occupied").join(n, ["gy", "gx"], "left")
    return free.agg(F.sum("walls").alias("wall_sum"), F.count_if(F.coalesce("open", F.lit(0)) <= 2).alias("doorways"))


@query(
    "j7_g22_map_merge",
    f""", {OCC}, one AS (SELECT gy, gx, CASE WHEN occ THEN 'occupied' WHEN (gy + gx) % 5 = 0 THEN 'unknown' ELSE 'free' END AS kind FROM grid),
    oc AS (SELECT a.i AS gy, b.i AS gx, (b.i + 5e-1) * 1e-1 AS wx, (a.i + 5e-1) * 1e-1 AS wy FROM range(80) a(i), range(120) b(i)),
    lk AS (SELECT gy, gx, CAST(floor(wy / 5e-2) AS BIGINT) AS ay, CAST(floor(wx / 5e-2) AS BIGINT) AS ax, CAST(floor((-(wx - 1e0) * sin(5e-1) + (wy - 5e-1) * cos(5e-1)) / 5e-2) AS BIGINT) AS by, CAST(floor(((wx - 1e0) * cos(5e-1) + (wy - 5e-1) * sin(5e-1)) / 5e-2) AS BIGINT) AS bx FROM oc),
    mm AS (SELECT l.gy, l.gx, a.kind AS k1, b.kind AS k2 FROM lk l LEFT JOIN one a ON a.gy = ay AND a.gx = ax LEFT JOIN one b ON b.gy = l.by AND b.gx = l.bx)
    SELECT CASE WHEN k1 = 'occupied' OR k2 = 'occupied' THEN 0 WHEN k1 = 'free' OR k2 = 'free' THEN 254 ELSE 205 END AS pixel, count(*) AS n, CAST(sum(gy) AS BIGINT) AS sum_gy FROM mm GROUP BY 1""",
)
def g22(spark, d):
    one = obstacle_grid(spark, d).select("gy", "gx", F.when(F.col("occupied"), "occupied").when((F.col("gy") + F.col("gx")) % 5 == 0, "unknown").otherwise("free").alias("kind"))
    second = {"resolution": 0.05, "ox": 0.0, "oy": 0.0, "tx": 1.0, "ty": 0.5, "theta": 0.5, "first_resolution": 0.05, "first_ox": 0.0, "first_oy": 0.0}
    out = M.merged(one, one, second, {"resolution": 0.1, "ox": 0.0, "oy": 0.0, "width": 120, "height": 80})
    return out.groupBy("pixel").agg(F.count(F.lit(1)).alias("n"), F.sum("gy").alias("sum_gy"))


@query("t4_even_sample", f", {OCC}, f AS (SELECT gy, gx, row_number() OVER (ORDER BY gy, gx) - 1 AS i, count(*) OVER () AS n FROM grid WHERE NOT occ), k AS (SELECT DISTINCT CAST(floor(j * (n - 1) / 99e0) AS BIGINT) AS i FROM range(100) r(j), (SELECT max(n) AS n FROM f) m) SELECT gy, gx FROM f SEMI JOIN k USING (i)")
def t4(spark, d):
    free = obstacle_grid(spark, d).where("NOT occupied").select("gy", "gx")
    inside = F.row_number().over(Window.partitionBy("gy").orderBy("gx"))
    rows = free.groupBy("gy").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("gy").rowsBetween(Window.unboundedPreceding, -1)))
    numbered = free.withColumn("k", inside).join(rows.select("gy", F.coalesce("before", F.lit(0)).alias("before")), "gy").withColumn("i", F.col("before") + F.col("k") - 1)
    total = rows.agg(F.sum("n").alias("n"))
    picks = spark.range(100).join(F.broadcast(total)).select(F.floor(F.col("id") * (F.col("n") - 1) / F.lit(99.0)).cast("long").alias("i")).distinct()
    return numbered.join(F.broadcast(picks), "i", "left_semi").select("gy", "gx")
