"""Queries of the raster operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfloor.functions.fixtures import scan
from wayfloor.functions.shared import saved
from wayfloor.operators import grid as G
from wayfloor.operators import points as P
from wayfloor.plans.registry import query, rounded


def meta_sql(size: str, name: str = "meta") -> str:
    span = lambda c: f"CAST(ceil((max({c}) + 5e-1 - (min({c}) - 5e-1)) / {size}) + 1 AS BIGINT)"
    return f"{name} AS (SELECT min(x) - 5e-1 AS ox, min(y) - 5e-1 AS oy, {span('x')} AS w, {span('y')} AS h FROM scan)"


def bin_sql(size: str) -> str:
    clip = lambda c, o, n: f"least(greatest(CAST(floor(({c} - {o}) / {size}) AS BIGINT), 0), {n} - 1)"
    return f"{clip('y', 'oy', 'h')} AS gy, {clip('x', 'ox', 'w')} AS gx"


ANCHOR = "anc AS (SELECT quantile_cont(z, 5e-2) AS a FROM scan)"
CELLS = "cells AS (SELECT gy, gx, w, h FROM (SELECT unnest(range(h)) AS gy, w, h FROM meta) p, (SELECT unnest(range(w)) AS gx FROM meta) q)"


def occupancy_sql(size: str) -> str:
    return f"""{ANCHOR}, {meta_sql(size)}, {CELLS}, cnt AS (SELECT {bin_sql(size)}, count(*) AS n FROM scan, meta, anc WHERE z BETWEEN a + 5e-2 AND a + 1e0 GROUP BY ALL),
    grid AS (SELECT gy, gx, coalesce(n, 0) AS n, (gy = 0 OR gx = 0 OR gy = h - 1 OR gx = w - 1 OR coalesce(n, 0) >= 1) AS occ FROM cells LEFT JOIN cnt USING (gy, gx))"""


OCC = occupancy_sql("5e-2")
OCC20 = occupancy_sql("2e-1")


def scan_facts(spark, d):
    """The scan, with one row of its extremes and floor percentiles."""
    df = scan(spark, d)
    return df, P.floor_percentiles(df, [*G.extremes(), F.min("z").alias("z0")])


def obstacle_grid(spark, d, size=0.05, known=None):
    """The dense map, written, so that the points are read once for it; ``known`` is of ``scan_facts``, if there."""
    df, facts = known or scan_facts(spark, d)
    band = P.preset_of(facts).select(F.col("map_min").alias("z_min"), F.col("map_max").alias("z_max"))
    return saved(G.occupancy(df, band, size, meta=G.geometry(facts, size, 0.5)), "grid")


HEIGHTS = f"""{ANCHOR}, {meta_sql('2e-1')}, {CELLS}, obs AS (SELECT {bin_sql('2e-1')}, count(*) AS n, quantile_cont(z, 1e-1) AS z FROM scan, meta, anc WHERE z BETWEEN a AND a + 1e0 GROUP BY ALL HAVING count(*) >= 3),
    hm AS (SELECT c.gy, c.gx, c.w, c.h, o.z FROM cells c LEFT JOIN obs o USING (gy, gx))"""


def height_grid(spark, d, size=0.2, least=3):
    """Dense ``(gy, gx, z)`` with nulls, written, so that the points are read once for it, and the geometry."""
    df, facts = scan_facts(spark, d)
    meta = G.geometry(facts, size, 0.5)
    p = P.preset_of(facts).select(F.col("anchor").alias("z_min"), (F.col("anchor") + 1.0).alias("z_max"))
    band = df.join(F.broadcast(p)).where(F.col("z").between(F.col("z_min"), F.col("z_max")))
    known = G.height_map(band, meta, size, 0.10, least)
    return saved(G.scaffold(meta).select("gy", "gx").join(known.select("gy", "gx", "z"), ["gy", "gx"], "left"), "heights"), meta


def mask_sum(df, flag):
    on = F.col(flag).cast("long")
    return df.agg(F.sum(on).alias("cells"), F.sum(on * F.col("gy")).alias("sum_gy"), F.sum(on * F.col("gx")).alias("sum_gx"))


MASK = "CAST(sum(CAST({0} AS BIGINT)) AS BIGINT) AS cells, CAST(sum(CAST({0} AS BIGINT) * gy) AS BIGINT) AS sum_gy, CAST(sum(CAST({0} AS BIGINT) * gx) AS BIGINT) AS sum_gx"


@query("a5_occupancy_grid", f", {OCC} SELECT gy, gx, n, occ AS occupied FROM grid")
def a5(spark, d):
    return obstacle_grid(spark, d)


@query("a10_internal_cell_size", ", r(res) AS (VALUES (5e-2), (1e-1), (3e-1)), z AS (SELECT res, res * greatest(1, ceil(2e-1 / res)) AS size FROM r), c AS (SELECT DISTINCT res, size, floor(y / size) AS gy, floor(x / size) AS gx FROM scan, z) SELECT res, round(size, 6) AS size, count(*) AS cells FROM c GROUP BY 1, 2")
def a10(spark, d):
    """The cells of the scan at the size that terrain is judged on, for some resolutions of the map."""
    r = spark.createDataFrame([(0.05,), (0.1,), (0.3,)], "res double").withColumn("size", F.col("res") * F.greatest(F.lit(1).cast("long"), F.ceil(F.lit(0.2) / F.col("res"))))
    cells = scan(spark, d).join(F.broadcast(r)).select("res", "size", F.floor(F.col("y") / F.col("size")).alias("gy"), F.floor(F.col("x") / F.col("size")).alias("gx")).distinct()
    return rounded(cells.groupBy("res", "size").agg(F.count(F.lit(1)).alias("cells")))


@query("a18_obstacle_counts", f", {OCC} SELECT count(*) FILTER (occ) AS occupied, count(*) FILTER (NOT occ) AS free, round(count(*) FILTER (occ) * 25e-4, 4) AS occupied_area, round(count(*) FILTER (NOT occ) * 25e-4, 4) AS free_area FROM grid")
def a18(spark, d):
    from wayfloor.operators.maps import obstacle_counts

    return obstacle_counts(obstacle_grid(spark, d), 0.05)


PIXELS = "px AS (SELECT gy, gx, occ, CASE WHEN occ THEN 0 WHEN (gy + gx) % 5 = 0 THEN 205 ELSE 254 END AS pixel FROM grid)"


def pixels(spark, d):
    return obstacle_grid(spark, d).withColumn("pixel", F.when(F.col("occupied"), 0).when((F.col("gy") + F.col("gx")) % 5 == 0, 205).otherwise(254))


@query("f6_blocked_cells", f", {OCC}, {PIXELS}, t(thresh) AS (VALUES (196e-3), (25e-2)) SELECT thresh, count(*) FILTER (pixel < ceil(255 * (1 - thresh))) AS blocked FROM px, t GROUP BY 1")
def f6(spark, d):
    df = pixels(spark, d)
    one = lambda t: G.blocked_cells(df, t).agg(F.lit(t).alias("thresh"), F.sum(F.col("blocked").cast("long")).alias("blocked"))
    return one(0.196).unionByName(one(0.25))


@query("f7_pixel_classes", f", {OCC}, {PIXELS} SELECT CASE WHEN 1 - pixel / 255e0 <= 196e-3 THEN 'free' WHEN 1 - pixel / 255e0 >= 65e-2 THEN 'occupied' ELSE 'unknown' END AS kind, count(*) AS n FROM px GROUP BY 1")
def f7(spark, d):
    return G.pixel_classes(pixels(spark, d), 0.196).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("f8_rectangle_selection", f", {OCC} SELECT count(*) AS n, count(*) FILTER (occ) AS occupied FROM grid, (SELECT max(gy) + 1 AS h FROM grid) m WHERE gx BETWEEN 20 AND 90 AND h - 1 - gy BETWEEN 10 AND 60")
def f8(spark, d):
    from wayfloor.operators.selection import in_rectangle

    df = obstacle_grid(spark, d).join(F.broadcast(G.bounds(scan(spark, d), 0.05, 0.5).select("height")))
    return df.where(in_rectangle(20, 10, 90, 60)).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("occupied").cast("long")).alias("occupied"))


POLY = [(20.0, 10.0), (120.0, 20.0), (90.0, 100.0), (60.0, 50.0), (25.0, 90.0)]
POLY_SQL = "pv(i, px, py) AS (VALUES " + ", ".join(f"({i}, {x:.0f}e0, {y:.0f}e0)" for i, (x, y) in enumerate(POLY)) + "), pe AS (SELECT a.px AS x1, a.py AS y1, b.px AS x2, b.py AS y2 FROM pv a JOIN pv b ON b.i = (a.i + 1) % 5)"


@query(
    "f8_polygon_selection",
    f", {OCC}, {POLY_SQL}, c AS (SELECT gy, gx, occ, gx + 5e-1 AS cx, (SELECT max(gy) FROM grid) - gy + 5e-1 AS cy FROM grid), k AS (SELECT gy, gx, occ, count(*) FILTER ((y1 > cy) <> (y2 > cy) AND cx < (x2 - x1) * (cy - y1) / (y2 - y1) + x1) AS c FROM c, pe GROUP BY ALL) SELECT count(*) AS n, count(*) FILTER (occ) AS occupied FROM k WHERE c % 2 = 1",
)
def f8p(spark, d):
    from wayfloor.operators.selection import in_polygon

    df = obstacle_grid(spark, d).join(F.broadcast(G.bounds(scan(spark, d), 0.05, 0.5).select("height")))
    return df.where(in_polygon(POLY)).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("occupied").cast("long")).alias("occupied"))


@query("f9_selection_applied", f", {OCC}, s AS (SELECT gy, gx, (occ OR NOT sel) AS blocked, (NOT occ AND sel) AS floor FROM (SELECT *, gx BETWEEN 20 AND 90 AND (SELECT max(gy) FROM grid) - gy BETWEEN 10 AND 60 AS sel FROM grid) q) SELECT count(*) FILTER (blocked) AS blocked, count(*) FILTER (floor) AS floor FROM s")
def f9(spark, d):
    from wayfloor.operators.selection import apply_selection, in_rectangle

    df = obstacle_grid(spark, d).join(F.broadcast(G.bounds(scan(spark, d), 0.05, 0.5).select("height")))
    df = df.select("*", F.col("occupied").alias("blocked"), (~F.col("occupied")).alias("floor"), (~F.col("occupied")).alias("trav"))
    out = apply_selection(df.withColumn("sel", in_rectangle(20, 10, 90, 60)))
    return out.agg(F.sum(F.col("blocked").cast("long")).alias("blocked"), F.sum(F.col("floor").cast("long")).alias("floor"))


BOXES = "bx AS (SELECT label, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM scan GROUP BY 1)"


def label_boxes(spark, d):
    """The box around the points of every label, as a user would draw it."""
    return scan(spark, d).groupBy("label").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))


@query("f10_selection_geometry", f", {BOXES} SELECT label AS id, round((x1 - x0) * (y1 - y0), 6) AS area, round((x0 + x1) / 2, 6) AS cx, round((y0 + y1) / 2, 6) AS cy, round(x0, 6) AS x_min, round(x1, 6) AS x_max, round(y0, 6) AS y_min, round(y1, 6) AS y_max FROM bx")
def f10(spark, d):
    """The geometry of a selection around each label."""
    from wayfloor.operators.selection import polygon_geometry

    corners = F.array(*(F.struct(F.lit(i).alias("i"), F.col(x).alias("x"), F.col(y).alias("y")) for i, (x, y) in enumerate((("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1")))))
    return rounded(polygon_geometry(label_boxes(spark, d).select(F.col("label").alias("id"), F.explode(corners).alias("c")).select("id", "c.*")))


# Bodies of robots that would fill the boxes of things: a rectangle for most, a circle for pallets, none for walls.
BODIES = f"{BOXES}, rb AS (SELECT label, CASE WHEN label NOT IN (1, 14) THEN round(x1 - x0, 3) END AS width, CASE WHEN label NOT IN (1, 14) THEN round(y1 - y0, 3) END AS length, CASE WHEN label = 14 THEN round((x1 - x0) / 2, 3) END AS radius FROM bx)"


def bodies(spark, d):
    b, rect = label_boxes(spark, d), ~F.col("label").isin(1, 14)
    side = lambda a, c: F.round(F.col(a) - F.col(c), 3)
    return b.select("label", F.when(rect, side("x1", "x0")).alias("width"), F.when(rect, side("y1", "y0")).alias("length"), F.when(F.col("label") == 14, F.round((F.col("x1") - F.col("x0")) / 2, 3)).alias("radius"))


@query("f12_footprint_pixels", f", {BODIES} SELECT label, CAST(ceil(coalesce(width / 2, radius, 35e-2) / 5e-2) AS BIGINT) AS infl_x, CAST(ceil(coalesce(length / 2, radius, 35e-2) / 5e-2) AS BIGINT) AS infl_y, width IS NOT NULL AS is_rect FROM rb")
def f12(spark, d):
    from wayfloor.operators.robots import footprint_pixels

    r = bodies(spark, d).select("label", (F.col("width") / 2).alias("half_w"), (F.col("length") / 2).alias("half_l"), "radius")
    return footprint_pixels(r, 0.05).select("label", "infl_x", "infl_y", "is_rect")


@query("f13_robot_parameters", f", {BODIES}, r AS (SELECT label, CASE WHEN radius IS NULL THEN 'rectangle' ELSE 'circle' END AS shape, radius, width, length, CASE WHEN label = 14 THEN 0e0 ELSE 5e-2 END AS inflation FROM rb WHERE label <> 1) SELECT CAST(label AS VARCHAR) AS name, shape, round(CASE WHEN shape = 'circle' THEN radius ELSE sqrt(width * width / 4 + length * length / 4) END + inflation, 6) AS radius, round(CASE WHEN shape = 'circle' THEN radius ELSE width / 2 END + inflation, 6) AS half_w, round(CASE WHEN shape = 'circle' THEN radius ELSE length / 2 END + inflation, 6) AS half_l, inflation AS inflation_radius FROM r")
def f13(spark, d):
    from wayfloor.operators.robots import parameters

    r = bodies(spark, d).where("label <> 1")
    shape, margin = F.when(F.col("radius").isNull(), "rectangle").otherwise("circle"), F.when(F.col("label") == 14, 0.0).otherwise(0.05)
    return rounded(parameters(r.select(F.col("label").cast("string").alias("name"), shape.alias("shape"), "radius", "width", "length", margin.alias("inflation"))))


@query("f18_brush_edits", f", {OCC}, e(seq, cy, cx, r, val) AS (VALUES (1, 50, 60, 8, 0), (2, 52, 64, 5, 254), (3, 90, 30, 6, 0)), hit AS (SELECT gy, gx, arg_max(val, seq) AS val FROM grid, e WHERE (gy - cy) * (gy - cy) + (gx - cx) * (gx - cx) <= r * r GROUP BY ALL) SELECT coalesce(val, CASE WHEN occ THEN 0 ELSE 254 END) AS pixel, count(*) AS n FROM grid LEFT JOIN hit USING (gy, gx) GROUP BY 1")
def f18(spark, d):
    from wayfloor.operators.selection import brush

    edits = spark.createDataFrame([(1, 50, 60, 8, 0), (2, 52, 64, 5, 254), (3, 90, 30, 6, 0)], "seq int, cy int, cx int, r int, val int")
    base = obstacle_grid(spark, d).select("gy", "gx", F.when(F.col("occupied"), 0).otherwise(254).alias("pixel"))
    return brush(base, edits).groupBy("pixel").agg(F.count(F.lit(1)).alias("n"))


@query("g1_dilate_rectangle", f", {OCC}, o AS (SELECT DISTINCT gy + a.i AS gy, gx + b.i AS gx FROM grid, range(-4, 5) a(i), range(-3, 4) b(i) WHERE occ) SELECT {MASK.format('(o.gy IS NOT NULL)').replace('* gy', '* g.gy').replace('* gx', '* g.gx')} FROM grid g LEFT JOIN o ON g.gy = o.gy AND g.gx = o.gx")
def g1(spark, d):
    return mask_sum(G.dilate_rectangle(obstacle_grid(spark, d), "occupied", 3, 4), "occupied")


@query("g1_dilate_disc", f", {OCC}, o AS (SELECT DISTINCT gy + a.i AS gy, gx + b.i AS gx FROM grid, range(-3, 4) a(i), range(-3, 4) b(i) WHERE occ AND a.i * a.i + b.i * b.i <= 9) SELECT {MASK.format('TRUE')} FROM o SEMI JOIN cells USING (gy, gx)")
def g1d(spark, d):
    df = obstacle_grid(spark, d)
    grown = G.dilate(df.where("occupied").select("gy", "gx"), G.disc(3)).join(df.select("gy", "gx"), ["gy", "gx"], "left_semi")
    return mask_sum(grown.withColumn("on", F.lit(True)), "on")


NEAR = "range(-1, 2) a(i), range(-1, 2) b(i)"
MEDIAN = f"""md AS (SELECT hm.gy, hm.gx, hm.w, hm.h, CASE WHEN hm.z IS NOT NULL THEN m.z END AS z FROM hm LEFT JOIN
    (SELECT gy + a.i AS gy, gx + b.i AS gx, quantile_cont(z, 5e-1) AS z FROM hm, {NEAR} WHERE z IS NOT NULL GROUP BY ALL) m USING (gy, gx))"""
SMOOTH = """sm AS (SELECT md.gy, md.gx, md.w, md.h, CASE WHEN md.z IS NOT NULL THEN m.z END AS z FROM md LEFT JOIN
    (SELECT gy + a.i AS gy, gx + b.i AS gx, sum(exp(-(a.i * a.i + b.i * b.i) / 2e0) * z) / sum(exp(-(a.i * a.i + b.i * b.i) / 2e0)) AS z FROM md, range(-2, 3) a(i), range(-2, 3) b(i) WHERE z IS NOT NULL GROUP BY ALL) m USING (gy, gx))"""


def fill_sql(source: str, rounds: int) -> str:
    out, last = [], source
    for i in range(rounds):
        out.append(
            f"""f{i} AS (SELECT p.gy, p.gx, p.w, p.h, coalesce(p.z, m.z) AS z FROM {last} p LEFT JOIN (SELECT ((gy + dy) % h + h) % h AS gy, ((gx + dx) % w + w) % w AS gx, avg(z) AS z
            FROM {last}, (VALUES (-1, 0), (1, 0), (0, -1), (0, 1)) o(dy, dx) WHERE z IS NOT NULL GROUP BY ALL) m USING (gy, gx))"""
        )
        last = f"f{i}"
    return ", ".join(out)


def grad_sql(source: str) -> str:
    d = lambda by, on: f"CASE WHEN {on} = 0 THEN lead(z) OVER {by} - z WHEN {on} = {'w' if on == 'gx' else 'h'} - 1 THEN z - lag(z) OVER {by} ELSE (lead(z) OVER {by} - lag(z) OVER {by}) / 2e0 END / 2e-1"
    return f"""gr AS (SELECT gy, gx, w, h, z, {d('r', 'gx')} AS dzdx, {d('c', 'gy')} AS dzdy FROM {source} WINDOW r AS (PARTITION BY gy ORDER BY gx), c AS (PARTITION BY gx ORDER BY gy)),
    sl AS (SELECT *, degrees(atan(sqrt(dzdx * dzdx + dzdy * dzdy))) AS slope FROM gr)"""


def field(df, value):
    return rounded(df.select(F.count(value).alias("n"), F.sum(value).alias("total"), F.sum(F.col(value) * F.col("gx")).alias("by_gx"), F.max(value).alias("most")), 4)


FIELD = "count({0}) AS n, round(sum({0}), 4) AS total, round(sum({0} * gx), 4) AS by_gx, round(max({0}), 4) AS most"


@query("a6_xy_binning", f", {meta_sql('2e-1')} SELECT gy, gx, count(*) AS n FROM (SELECT {bin_sql('2e-1')} FROM scan, meta) q GROUP BY ALL")
def a6(spark, d):
    df = scan(spark, d)
    return G.binned(df, G.bounds(df, 0.2, 0.5), 0.2).groupBy("gy", "gx").agg(F.count(F.lit(1)).alias("n"))


@query("a7_ground_height", f", {meta_sql('2e-1')} SELECT gy, gx, count(*) AS n, round(quantile_cont(z, 1e-1), 6) + 0e0 AS z FROM (SELECT {bin_sql('2e-1')}, z FROM scan, meta) q GROUP BY gy, gx")
def a7(spark, d):
    df = scan(spark, d)
    return rounded(G.height_map(df, G.bounds(df, 0.2, 0.5), 0.2))


@query("a8_ramp_height", f", {HEIGHTS} SELECT {FIELD.format('z')} FROM hm")
def a8(spark, d):
    return field(height_grid(spark, d)[0], "z")


@query("g3_median", f", {HEIGHTS}, {MEDIAN} SELECT {FIELD.format('z')} FROM md")
def g3(spark, d):
    return field(G.median3(height_grid(spark, d)[0]), "z")


@query("g4_gaussian", f", {HEIGHTS}, {MEDIAN}, {SMOOTH} SELECT {FIELD.format('z')} FROM sm")
def g4(spark, d):
    return field(G.gaussian(G.median3(height_grid(spark, d)[0]), 1.0), "z")


@query("g5_fill_holes", f", {HEIGHTS}, {fill_sql('hm', 3)} SELECT {FIELD.format('z')} FROM f2")
def g5(spark, d):
    cells, meta = height_grid(spark, d)
    return field(G.fill_holes(cells, 3, meta), "z")


@query("g6_g7_gradient_slope", f", {HEIGHTS}, {fill_sql('hm', 2)}, {grad_sql('f1')} SELECT {FIELD.format('slope')} FROM sl")
def g67(spark, d):
    cells, meta = height_grid(spark, d)
    return field(G.gradients(G.fill_holes(cells, 2, meta), 0.2), "slope")


STEP = "st AS (SELECT hm.*, coalesce(s.step, 0e0) AS step FROM hm LEFT JOIN (SELECT p.gy, p.gx, max(abs(p.z - q.z)) AS step FROM hm p JOIN hm q ON abs(p.gy - q.gy) + abs(p.gx - q.gx) = 1 AND q.gy BETWEEN p.gy - 1 AND p.gy + 1 WHERE p.z IS NOT NULL AND q.z IS NOT NULL GROUP BY ALL) s USING (gy, gx))"


@query(
    "g8_step_height",
    f", {HEIGHTS}, nb AS (SELECT gy + dy AS gy, gx + dx AS gx, z AS q FROM hm, (VALUES (-1, 0), (1, 0), (0, -1), (0, 1)) o(dy, dx) WHERE z IS NOT NULL), st AS (SELECT hm.gy, hm.gx, coalesce(max(abs(z - q)), 0e0) AS step FROM hm LEFT JOIN nb USING (gy, gx) GROUP BY ALL) SELECT {FIELD.format('step')} FROM st",
)
def g8(spark, d):
    return field(G.step_height(height_grid(spark, d)[0]), "step")


CROSS2 = "(SELECT a.i AS dy, b.i AS dx FROM range(-2, 3) a(i), range(-2, 3) b(i) WHERE abs(a.i) + abs(b.i) <= 2) o"


@query(
    "g9_morphological_close",
    f", {OCC20}, di AS (SELECT DISTINCT gy + dy AS gy, gx + dx AS gx FROM grid, {CROSS2} WHERE occ), gd AS (SELECT g.gy, g.gx, di.gy IS NOT NULL AS on_ FROM cells g LEFT JOIN di ON g.gy = di.gy AND g.gx = di.gx), er AS (SELECT DISTINCT gy + dy AS gy, gx + dx AS gx FROM gd, {CROSS2} WHERE NOT on_) SELECT {MASK.format('(on_ AND er.gy IS NULL)').replace('* gy', '* gd.gy').replace('* gx', '* gd.gx')} FROM gd LEFT JOIN er ON gd.gy = er.gy AND gd.gx = er.gx",
)
def g9(spark, d):
    return mask_sum(G.close(obstacle_grid(spark, d, 0.2), "occupied", 2), "occupied")


TILE = "SELECT CAST(floor(gy / 4) AS BIGINT) AS ty, CAST(floor(gx / 4) AS BIGINT) AS tx, {0} AS {1} FROM grid GROUP BY 1, 2"


@query("g10_all_free_tiles", f", {OCC} {TILE.format('bool_and(NOT occ) AND count(*) = 16', 'free')}")
def g10(spark, d):
    return G.tiles(obstacle_grid(spark, d).withColumn("free", ~F.col("occupied")), "free", 4, "all")


@query("g10_upsample", f", {OCC}, t AS ({TILE.format('bool_and(NOT occ) AND count(*) = 16', 'free')}) SELECT {MASK.format('free')} FROM grid JOIN t ON ty = CAST(floor(gy / 4) AS BIGINT) AND tx = CAST(floor(gx / 4) AS BIGINT)")
def g10u(spark, d):
    df = obstacle_grid(spark, d).withColumn("free", ~F.col("occupied"))
    return mask_sum(G.upsample(G.tiles(df, "free", 4, "all"), df, "free", 4), "free")


@query("g11_any_blocked_tiles", f", {OCC} {TILE.format('bool_or(occ) OR count(*) < 16', 'blocked')}")
def g11(spark, d):
    return G.tiles(obstacle_grid(spark, d).withColumnRenamed("occupied", "blocked"), "blocked", 4, "any")


@query("g12_border", f", {OCC} SELECT count(*) FILTER (gy = 0 OR gx = 0 OR gy = m.h OR gx = m.w) AS border, count(*) FILTER (occ AND (gy = 0 OR gx = 0 OR gy = m.h OR gx = m.w)) AS occupied FROM grid, (SELECT max(gy) AS h, max(gx) AS w FROM grid) m")
def g12(spark, d):
    df = obstacle_grid(spark, d).join(F.broadcast(G.bounds(scan(spark, d), 0.05, 0.5)))
    edge = (F.col("gy") == 0) | (F.col("gx") == 0) | (F.col("gy") == F.col("height") - 1) | (F.col("gx") == F.col("width") - 1)
    return df.agg(F.sum(edge.cast("long")).alias("border"), F.sum((edge & F.col("occupied")).cast("long")).alias("occupied"))


BOXES = [(0, 0, 0, 20, 20), (1, 10, 15, 60, 90), (2, 100, 100, 130, 200)]


@query("w5_rectangle_sums", f", {OCC}, b(id, y0, x0, y1, x1) AS (VALUES {', '.join(map(str, BOXES))}) SELECT id, CAST(sum(n) AS BIGINT) AS total FROM grid, b WHERE gy BETWEEN y0 AND y1 AND gx BETWEEN x0 AND x1 GROUP BY id")
def w5(spark, d):
    boxes = spark.createDataFrame(BOXES, "id int, y0 long, x0 long, y1 long, x1 long")
    return G.rectangle_sums(G.prefix_sums(obstacle_grid(spark, d), "n"), boxes)


@query("s1_s3_mask_sets", f", {OCC}, p AS (SELECT gy, gx FROM grid WHERE occ), q AS (SELECT gy, gx + 3 AS gx FROM grid WHERE occ) SELECT (SELECT count(*) FROM (SELECT * FROM p UNION SELECT * FROM q)) AS either, (SELECT count(*) FROM (SELECT * FROM p INTERSECT SELECT * FROM q)) AS both_, (SELECT count(*) FROM (SELECT * FROM p EXCEPT SELECT * FROM q)) AS first_only")
def s13(spark, d):
    p = obstacle_grid(spark, d).where("occupied").select("gy", "gx")
    q = p.withColumn("gx", F.col("gx") + 3)
    both = p.withColumn("p", F.lit(1)).join(q.withColumn("q", F.lit(1)), ["gy", "gx"], "full")
    n = lambda c, name: F.sum(c.cast("long")).alias(name)
    return both.agg(n(F.lit(True), "either"), n(F.col("p").isNotNull() & F.col("q").isNotNull(), "both_"), n(F.col("q").isNull(), "first_only"))
