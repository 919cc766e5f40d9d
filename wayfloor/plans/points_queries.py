"""Queries of the point operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfloor.functions.fixtures import scan
from wayfloor.operators import points as P
from wayfloor.plans.registry import query, rounded

Z = "count(*) AS n, round(sum(x), 2) + 0e0 AS sum_x, round(sum(y), 2) + 0e0 AS sum_y, round(sum(z), 2) + 0e0 AS sum_z"


def totals(df):
    return rounded(df.agg(F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(f"sum_{c}") for c in "xyz")), 2)


DIRTY = "dirty AS (SELECT point_id, CASE WHEN point_id % 97 = 0 THEN CAST('NaN' AS DOUBLE) ELSE x END AS x, CASE WHEN point_id % 89 = 0 THEN CAST('Infinity' AS DOUBLE) ELSE y END AS y, z FROM scan)"


@query("f1_finite_filter", f", {DIRTY} SELECT {Z} FROM dirty WHERE isfinite(x) AND isfinite(y) AND isfinite(z)")
def f1(spark, d):
    df = scan(spark, d)
    dirty = df.withColumns({"x": F.when(F.col("point_id") % 97 == 0, float("nan")).otherwise(F.col("x")), "y": F.when(F.col("point_id") % 89 == 0, float("inf")).otherwise(F.col("y"))})
    return totals(P.finite(dirty))


@query("f2_z_band", f" SELECT {Z} FROM scan WHERE z BETWEEN 5e-2 AND 1e0")
def f2(spark, d):
    return totals(P.z_band(scan(spark, d), 0.05, 1.0))


PRESET = "preset AS (SELECT p2 AS floor_low, p5 AS anchor, p2 - 25e-2 AS clean_min, p2 + 4e0 AS clean_max, p5 + 5e-2 AS map_min, p5 + 1e0 AS map_max FROM (SELECT quantile_cont(z, 2e-2) AS p2, quantile_cont(z, 5e-2) AS p5 FROM scan) q)"
R = lambda *cs: ", ".join(f"round({c}, 6) + 0e0 AS {c}" for c in cs)


@query("f3_floor_preset", f", {PRESET} SELECT {R('floor_low', 'anchor', 'clean_min', 'clean_max', 'map_min', 'map_max')} FROM preset")
def f3(spark, d):
    return rounded(P.floor_preset(scan(spark, d)))


REQUESTS = [("auto", 0.05, 1.0), ("auto", -0.5, 1.0), ("absolute", 0.05, 1.0), ("floor_relative", -0.5, None), ("auto", None, None)]


@query(
    "f4_projection_bounds",
    f""", {PRESET}, req(mode, low, high) AS (VALUES ('auto', 5e-2, 1e0), ('auto', -5e-1, 1e0), ('absolute', 5e-2, 1e0), ('floor_relative', -5e-1, NULL), ('auto', NULL, NULL)),
    s AS (SELECT *, CASE WHEN mode = 'floor_relative' OR (mode = 'auto' AND coalesce(low, 0e0) >= 0 AND coalesce(high, 0e0) >= 0) THEN anchor ELSE 0e0 END AS shift FROM req, preset)
    SELECT mode, low, high, round(coalesce(low + shift, CAST('-Infinity' AS DOUBLE)), 6) AS z_min, round(coalesce(high + shift, CAST('Infinity' AS DOUBLE)), 6) AS z_max FROM s""",
)
def f4(spark, d):
    return rounded(P.projection_bounds(spark.createDataFrame(REQUESTS, "mode string, low double, high double"), scan(spark, d)))


@query(
    "f5_sidecar_bounds",
    f""", {PRESET}, req(low, high) AS (VALUES (0e0, 1e0), (-5e-1, 2e0), (1e0, 0e0))
    SELECT low, high, round(CASE WHEN high > low AND high - low >= 2e0 THEN low ELSE clean_min END, 6) AS z_min,
    round(CASE WHEN high > low AND high - low >= 2e0 THEN high ELSE clean_max END, 6) AS z_max FROM req, preset""",
)
def f5(spark, d):
    req = spark.createDataFrame([(0.0, 1.0), (-0.5, 2.0), (1.0, 0.0)], "low double, high double")
    return rounded(P.sidecar_bounds(req, P.floor_preset(scan(spark, d))))


@query("f11_rotate", " SELECT count(*) AS n, round(sum(x * cos(radians(3e1)) - y * sin(radians(3e1))), 3) AS sum_x, round(sum(x * sin(radians(3e1)) + y * cos(radians(3e1))), 3) AS sum_y FROM scan")
def f11(spark, d):
    turned = P.rotate(scan(spark, d), 30)
    return rounded(turned.agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("sum_x"), F.sum("y").alias("sum_y")), 3)


@query("f14_label_clip", " SELECT least(greatest(label + point_id % 9 - 3, 0), 17) AS label, count(*) AS n FROM scan GROUP BY 1")
def f14(spark, d):
    from wayfloor.operators.semantic import clip_labels

    df = scan(spark, d).withColumn("label", F.col("label") + F.col("point_id") % 9 - 3)
    return clip_labels(df).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("f15_stride_sample", " SELECT count(*) AS n, CAST(sum(point_id) AS BIGINT) AS sum_id FROM (SELECT point_id, row_number() OVER (ORDER BY point_id, x, y, z) - 1 AS i FROM scan WHERE z <= 1e0) q WHERE i % 7 = 0")
def f15(spark, d):
    return P.stride(P.z_band(scan(spark, d), None, 1.0), 7, ["point_id", "x", "y", "z"]).agg(F.count(F.lit(1)).alias("n"), F.sum("point_id").alias("sum_id"))


@query(
    "f16_height_colormap",
    """, q AS (SELECT quantile_cont(z, 5e-2) AS lo, quantile_cont(z, 95e-2) AS hi FROM scan),
    t AS (SELECT least(greatest((z - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1e0 END, 0e0), 1e0) AS t FROM scan, q),
    c AS (SELECT CASE WHEN t < 25e-2 THEN 0e0 WHEN t < 5e-1 THEN (t - 25e-2) * 4 ELSE 1e0 END AS r,
    CASE WHEN t < 25e-2 THEN t * 4 WHEN t < 5e-1 THEN 1e0 WHEN t < 75e-2 THEN 1e0 - (t - 5e-1) * 4 ELSE 0e0 END AS g,
    CASE WHEN t < 25e-2 THEN 1e0 WHEN t < 5e-1 THEN 1e0 - (t - 25e-2) * 4 ELSE 0e0 END AS b FROM t)
    SELECT count(*) AS n, round(sum(r), 3) AS r, round(sum(g), 3) AS g, round(sum(b), 3) AS b FROM c""",
)
def f16(spark, d):
    return rounded(P.height_colours(scan(spark, d)).agg(F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(c) for c in "rgb")), 3)


V = lambda s: ", ".join(f"CAST(floor({c} / {s}) AS BIGINT) AS v{c}" for c in "xyz")


@query("a1_voxel_downsample", f" SELECT {V('1e-1')}, count(*) AS n, {', '.join(f'round(avg({c}) * count(*), 6) + 0e0 AS sum_{c}' for c in 'xyz')} FROM scan GROUP BY ALL")
def a1(spark, d):
    # The means are shown times their points: the sums lie on a lattice that six places hold, where means may be halves.
    return rounded(P.voxel_downsample(scan(spark, d), 0.1).select("vx", "vy", "vz", "n", *((F.col(c) * F.col("n")).alias(f"sum_{c}") for c in "xyz")))


def density_sql(source: str, size: str, limit: str, prefix: str = "") -> str:
    k = f"floor(x / {size}) AS vx, floor(y / {size}) AS vy, floor(z / {size}) AS vz"
    return f"""{prefix}k AS (SELECT *, {k} FROM {source}), {prefix}c AS (SELECT vx, vy, vz, count(*) AS n FROM {prefix}k GROUP BY ALL),
    {prefix}o AS (SELECT a.i AS dx, b.i AS dy, c.i AS dz FROM range(-1, 2) a(i), range(-1, 2) b(i), range(-1, 2) c(i)),
    {prefix}s AS (SELECT vx + dx AS vx, vy + dy AS vy, vz + dz AS vz, sum(n) AS around FROM {prefix}c, {prefix}o GROUP BY ALL),
    {prefix}e AS (SELECT c.vx, c.vy, c.vz, s.around FROM {prefix}c c JOIN {prefix}s s USING (vx, vy, vz)),
    {prefix}keep AS (SELECT k.* EXCLUDE (vx, vy, vz) FROM {prefix}k k JOIN {prefix}e e USING (vx, vy, vz) WHERE around >= {limit})"""


@query("a2_density_filter", f", {density_sql('scan', '2e-1', '12')} SELECT {Z} FROM keep")
def a2(spark, d):
    return totals(P.density_filter(scan(spark, d), 0.2, 12))


@query("a2_density_filter_statistical", f", {density_sql('scan', '2e-1', '(SELECT greatest(1e0, avg(around) - 5e-1 * stddev_pop(around)) FROM e)')} SELECT {Z} FROM keep")
def a2s(spark, d):
    return totals(P.density_filter(scan(spark, d), 0.2, 1, 0.5))


@query(
    "a3_preclean",
    f""", band AS (SELECT x, y, z FROM scan WHERE z BETWEEN 1e-2 AND 8e-1), vox AS (SELECT avg(x) AS x, avg(y) AS y, avg(z) AS z FROM (SELECT *, {V('5e-2')} FROM band) q GROUP BY vx, vy, vz),
    {density_sql('vox', '15e-2', '3', 'r')}, {density_sql('rkeep', '15e-2', '(SELECT greatest(1e0, avg(around) - 12e-1 * stddev_pop(around)) FROM se)', 's')}
    SELECT {Z} FROM skeep""",
)
def a3(spark, d):
    return totals(P.preclean(scan(spark, d), 0.01, 0.8, 0.05, 0.15, 3, 1.2))


@query(
    "a4_noise_filter_2d",
    f""", k AS (SELECT *, floor(x / 2e-1) AS gx, floor(y / 2e-1) AS gy FROM scan), c AS (SELECT gx, gy, count(*) AS n FROM k GROUP BY ALL),
    s AS (SELECT gx + a.i AS gx, gy + b.i AS gy, sum(n) AS around FROM c, range(-2, 3) a(i), range(-2, 3) b(i) GROUP BY ALL)
    SELECT {Z} FROM k JOIN s USING (gx, gy) WHERE around >= 100""",
)
def a4(spark, d):
    return totals(P.noise_filter_2d(scan(spark, d), 0.5, 100))


@query("a12_z_summary", f" SELECT count(z) AS n, {', '.join(f'round({e}, 6) + 0e0 AS {a}' for e, a in (('min(z)', 'z_min'), ('max(z)', 'z_max'), ('avg(z)', 'z_mean'), ('quantile_cont(z, 2e-2)', 'p2'), ('quantile_cont(z, 5e-2)', 'p5'), ('quantile_cont(z, 5e-1)', 'median'), ('quantile_cont(z, 95e-2)', 'p95')))} FROM scan")
def a12(spark, d):
    return rounded(P.z_summary(scan(spark, d)))


@query("a12_z_top_bins", " SELECT CAST(floor(z / 25e-2) AS BIGINT) AS bin, count(*) AS n FROM scan GROUP BY 1 ORDER BY n DESC, bin LIMIT 15")
def a12b(spark, d):
    return P.z_bins(scan(spark, d)).orderBy(F.desc("n"), "bin").limit(15)


def adaptive_sql(requested: int) -> str:
    cands = [requested, *range(requested - 1, max(2, requested // 2) - 1, -1)]
    values = ", ".join(f"({c})" for c in cands)
    return f""", c AS (SELECT count(*) AS n FROM scan GROUP BY floor(x / 5e-2), floor(y / 5e-2)), v(cand) AS (VALUES {values}), k AS (SELECT cand, avg(CASE WHEN n >= cand THEN 1e0 ELSE 0e0 END) AS keep FROM c, v GROUP BY cand),
    a AS (SELECT coalesce(max(cand) FILTER (keep >= 75e-2), {max(2, requested // 2)}) AS applied FROM k)
    SELECT {requested} AS requested, applied, CASE WHEN applied = {requested} THEN 'requested' ELSE 'adaptive' END AS mode, round(keep, 6) AS keep_fraction FROM a JOIN k ON cand = applied"""


@query("a9_adaptive_threshold", adaptive_sql(6))
def a9(spark, d):
    counts = scan(spark, d).groupBy(P.cell(F.col("x"), 0.05), P.cell(F.col("y"), 0.05)).agg(F.count(F.lit(1)).alias("n"))
    return rounded(P.adaptive_threshold(counts, 6))
