"""Queries of components, horizontal reach and label operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfloor.functions.fixtures import scan
from wayfloor.functions.shared import saved
from wayfloor.operators import components as C
from wayfloor.operators import grid as G
from wayfloor.operators import horizontal as H
from wayfloor.operators import maps as M
from wayfloor.operators import semantic as S
from wayfloor.plans.grid_queries import MASK, OCC, OCC20, bin_sql, mask_sum, obstacle_grid, scan_facts
from wayfloor.plans.registry import query, rounded

PITCH = 1 << 24


def cc_sql(mask: str, name: str = "", by: str = "") -> str:
    """CTEs that label the cells of ``mask`` by runs: ``{name}cc(id, l)`` and ``{name}runs``."""
    b, same, head = (f"{by}, ", f"p.{by} = q.{by} AND ", f"CAST({by} AS BIGINT) * {1 << 48} + ") if by else ("", "", "")
    return f"""{name}runs AS MATERIALIZED (SELECT {b}gy, min(gx) AS a, max(gx) AS b, {head}gy * {PITCH} + min(gx) AS id FROM (SELECT {b}gy, gx, gx - row_number() OVER (PARTITION BY {b}gy ORDER BY gx) AS g FROM {mask}) q GROUP BY {b}gy, g),
    {name}e AS MATERIALIZED (SELECT p.id AS s, q.id AS t FROM {name}runs p JOIN {name}runs q ON {same}(q.gy = p.gy + 1 OR q.gy = p.gy - 1) AND p.a <= q.b AND q.a <= p.b),
    {name}cc(id, l) USING KEY (id) AS (SELECT id, id FROM {name}runs UNION SELECT e.t, min(c.l) FROM {name}cc c JOIN {name}e e ON c.id = e.s JOIN recurring.{name}cc r ON r.id = e.t WHERE c.l < r.l GROUP BY e.t)"""


def largest_sql(name: str = "", by: str = "") -> str:
    b = f"r.{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    group = f"{b}c.l" if by else "c.l"
    plain = f"{by}, " if by else ""
    return f"""{name}size AS (SELECT {b}c.l, sum(r.b - r.a + 1) AS n FROM {name}cc c JOIN {name}runs r USING (id) GROUP BY {group}), {name}best AS (SELECT l FROM (SELECT {plain}l, row_number() OVER ({part}ORDER BY n DESC, l) AS k FROM {name}size) q WHERE k = 1),
    {name}big AS (SELECT {b}r.gy, unnest(range(r.a, r.b + 1)) AS gx FROM {name}cc c JOIN {name}runs r USING (id) SEMI JOIN {name}best b ON b.l = c.l)"""


def dilated_sql(rx: int, ry: int, source: str = "grid", flag: str = "occ") -> str:
    return f"SELECT DISTINCT gy + a.i AS gy, gx + b.i AS gx FROM {source}, range({-ry}, {ry + 1}) a(i), range({-rx}, {rx + 1}) b(i) WHERE {flag}"


@query("c1_components", f", {OCC}, mask AS (SELECT gy, gx FROM grid WHERE occ), {cc_sql('mask')} SELECT c.l AS component, CAST(sum(r.b - r.a + 1) AS BIGINT) AS n FROM cc c JOIN runs r USING (id) GROUP BY c.l", recursive=True)
def c1(spark, d):
    return C.sizes(C.components(obstacle_grid(spark, d).where("occupied").select("gy", "gx")))


@query("c2_largest_component", f", {OCC}, mask AS (SELECT gy, gx FROM grid WHERE NOT occ), {cc_sql('mask')}, {largest_sql()} SELECT {MASK.format('TRUE')} FROM big", recursive=True)
def c2(spark, d):
    return mask_sum(C.largest(C.components(obstacle_grid(spark, d).where("NOT occupied").select("gy", "gx"))).withColumn("on", F.lit(True)), "on")


@query(
    "c3_drop_small_components",
    f", {OCC}, mask AS (SELECT gy, gx FROM grid WHERE occ), {cc_sql('mask')}, s AS (SELECT c.l FROM cc c JOIN runs r USING (id) GROUP BY c.l HAVING sum(r.b - r.a + 1) >= 20), k AS (SELECT r.gy, unnest(range(r.a, r.b + 1)) AS gx FROM cc c JOIN runs r USING (id) SEMI JOIN s ON s.l = c.l) SELECT {MASK.format('TRUE')} FROM k",
    recursive=True,
)
def c3(spark, d):
    labelled = C.components(obstacle_grid(spark, d).where("occupied").select("gy", "gx"))
    return mask_sum(C.drop_small(labelled, 20).withColumn("on", F.lit(True)), "on")


@query(
    "c5_component_of_start",
    f", {OCC}, di AS ({dilated_sql(2, 2)}), mask AS (SELECT gy, gx FROM cells ANTI JOIN di USING (gy, gx)), {cc_sql('mask')}, cellsl AS (SELECT r.gy, unnest(range(r.a, r.b + 1)) AS gx, c.l FROM cc c JOIN runs r USING (id)), seed AS (SELECT l FROM cellsl ORDER BY abs(gy - 70) + abs(gx - 110), gy, gx LIMIT 1) SELECT {MASK.format('TRUE')} FROM cellsl SEMI JOIN seed USING (l)",
    recursive=True,
)
def c5(spark, d):
    cells = obstacle_grid(spark, d).withColumnRenamed("occupied", "blocked")
    return mask_sum(H.reach_from(cells, 2, 2, 70, 110).withColumn("on", F.lit(True)), "on")


@query(
    "c10_distance_field",
    f""", {OCC20}, mask AS (SELECT gy, gx FROM grid WHERE NOT occ), st AS (SELECT gy, gx FROM mask ORDER BY gy, gx LIMIT 1), m2 AS MATERIALIZED (SELECT gy * 1000 + gx AS id FROM mask),
    nb AS MATERIALIZED (SELECT a.id AS s, b.id AS t FROM m2 a JOIN m2 b ON b.id IN (a.id + 1, a.id - 1, a.id + 1000, a.id - 1000)),
    dist(id, d) USING KEY (id) AS (SELECT gy * 1000 + gx, 0 FROM st UNION SELECT nb.t, min(x.d) + 1 FROM dist x JOIN nb ON nb.s = x.id LEFT JOIN recurring.dist r ON r.id = nb.t WHERE r.id IS NULL GROUP BY nb.t)
    SELECT count(*) AS n, max(d) AS furthest, CAST(sum(d) AS BIGINT) AS total FROM dist""",
    recursive=True,
)
def c10(spark, d):
    free = obstacle_grid(spark, d, 0.2).where("NOT occupied").select("gy", "gx")
    start = free.agg(F.min(F.struct("gy", "gx")).alias("s")).select("s.*")
    return C.distances(free, start).agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("furthest"), F.sum("d").alias("total"))


def reach_sql(rx: int, ry: int, name: str) -> str:
    return f"{name}di AS ({dilated_sql(rx, ry)}), {name}mask AS (SELECT gy, gx FROM cells ANTI JOIN {name}di USING (gy, gx)), {cc_sql(f'{name}mask', name)}, {largest_sql(name)}"


def reached(spark, d, rx, ry, grid=None):
    cells = (obstacle_grid(spark, d) if grid is None else grid).select("gy", "gx", F.col("occupied").alias("blocked"), (~F.col("occupied")).alias("floor"))
    return H.reach(cells, rx, ry)


SCORE = "round({0} * 25e-4, 6) AS accessible_area, round({1} * 25e-4, 6) AS floor_area, round(100e0 * {0} / {1}, 6) AS rii"


@query("a17_d5_d6_reach_score", f", {OCC}, {reach_sql(4, 6, 'a')} SELECT {SCORE.format('(SELECT count(*) FROM abig SEMI JOIN (SELECT gy, gx FROM grid WHERE NOT occ) f USING (gy, gx))', '(SELECT count(*) FROM grid WHERE NOT occ)')}", recursive=True)
def d5(spark, d):
    return rounded(M.score(reached(spark, d, 4, 6), 0.05))


BOTH = f"{OCC}, {reach_sql(1, 1, 'r')}, {reach_sql(4, 6, 'a')}, lc AS (SELECT gy, gx, label, count(*) AS n FROM (SELECT {bin_sql('5e-2')}, label FROM scan, meta, anc WHERE z BETWEEN a + 5e-2 AND a + 1e0) q GROUP BY ALL), lbl AS (SELECT gy, gx, label FROM (SELECT *, row_number() OVER (PARTITION BY gy, gx ORDER BY n DESC, label) AS k FROM lc) q WHERE k = 1)"


def two_robots(spark, d):
    grid = obstacle_grid(spark, d)
    ref = reached(spark, d, 1, 1, grid).select("gy", "gx", "blocked", "floor", F.col("accessible").alias("ref"))
    act = reached(spark, d, 4, 6, grid).select("gy", "gx", F.col("accessible").alias("act"))
    return ref.join(act, ["gy", "gx"])


@query("a19_coverage_counts", f", {BOTH} SELECT (SELECT count(*) FROM abig) AS covered, (SELECT count(*) FROM grid ANTI JOIN abig USING (gy, gx) WHERE NOT occ) AS uncovered, (SELECT count(*) FROM grid WHERE occ) AS blocked", recursive=True)
def a19(spark, d):
    return M.coverage_counts(reached(spark, d, 4, 6).withColumn("covered", F.col("accessible")))


@query("a20_compare_counts", f", {BOTH} SELECT (SELECT count(*) FROM abig) AS actual, (SELECT count(*) FROM rbig ANTI JOIN abig USING (gy, gx)) AS reference_only, (SELECT count(*) FROM rbig SEMI JOIN abig USING (gy, gx)) AS both_", recursive=True)
def a20(spark, d):
    return M.compare_counts(two_robots(spark, d))


@query("a13_label_mode", f", {BOTH} SELECT gy, gx, label FROM lbl", recursive=True)
def a13(spark, d):
    return labels(spark, d)


def labels(spark, d, size=0.05, known=None):
    """The most frequent label of every cell of the mapping band, written; ``known`` is of ``scan_facts``, if there."""
    from wayfloor.operators import points as P

    df, facts = known or scan_facts(spark, d)
    band = df.join(F.broadcast(P.preset_of(facts))).where(F.col("z").between(F.col("map_min"), F.col("map_max")))
    binned = G.binned(band.select("x", "y", "label"), G.geometry(facts, size, 0.5), size)
    counts = binned.groupBy("gy", "gx", "label").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("gy", "gx").agg(F.max(F.struct("n", (-F.col("label")).alias("l"))).alias("m"))
    return saved(best.select("gy", "gx", (-F.col("m.l")).cast("int").alias("label")), "labels")


def map_labels(spark, d, size=0.05):
    """The most frequent label of every cell of the map, over all heights, so that free floor has one."""
    df = scan(spark, d)
    binned = G.binned(df.select("x", "y", "label"), G.bounds(df, size, 0.5), size)
    counts = binned.groupBy("gy", "gx", "label").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("gy", "gx").agg(F.max(F.struct("n", (-F.col("label")).alias("l"))).alias("m"))
    return best.select("gy", "gx", (-F.col("m.l")).cast("int").alias("label"))


NAMES = "dim(label, name, fixation, priority) AS (VALUES " + ", ".join(f"({i}, '{n}', '{f}', {S.PRIORITY.index(f)})" for i, n, f, *_ in S.LABELS) + ")"
GAP = f"""{BOTH}, {NAMES}, missed AS (SELECT gy, gx FROM rbig ANTI JOIN abig USING (gy, gx)), mc AS (SELECT gy, gx, label, count(*) AS n FROM (SELECT {bin_sql('5e-2')}, label FROM scan, meta) q GROUP BY ALL),
    near AS (SELECT gy, gx, label FROM missed JOIN (SELECT gy, gx, label FROM mc QUALIFY row_number() OVER (PARTITION BY gy, gx ORDER BY n DESC, label) = 1) ml USING (gy, gx)),
    gap AS (SELECT coalesce(n.label, -1) AS label, coalesce(name, 'No semantic data') AS name, coalesce(fixation, 'Unknown') AS fixation, coalesce(priority, 4) AS priority, count(*) AS cells, count(*) * 25e-4 AS area, 100e0 * count(*) / (SELECT count(*) FROM missed) AS pct FROM missed LEFT JOIN near n USING (gy, gx) LEFT JOIN dim ON dim.label = n.label WHERE name IS NOT NULL OR n.label IS NULL GROUP BY 1, 2, 3, 4)"""


def gap(spark, d):
    """Missed cells by their own label."""
    missed = two_robots(spark, d).where("ref AND NOT act").select("gy", "gx")
    return S.gap_by_label(missed, map_labels(spark, d), S.label_dimension(spark), 0.0025)


@query("a14_gap_by_label", f", {GAP} SELECT label, name, fixation, priority, cells, round(area, 6) AS area, round(pct, 6) AS pct FROM gap", recursive=True)
def a14(spark, d):
    return rounded(gap(spark, d))


@query("a15_gap_by_fixation", f", {GAP} SELECT fixation, priority, CAST(sum(cells) AS BIGINT) AS cells, round(sum(area), 6) AS area, round(sum(pct), 6) AS pct FROM gap GROUP BY 1, 2", recursive=True)
def a15(spark, d):
    return rounded(S.gap_by_fixation(gap(spark, d)))


@query("a28_inflation_halo", f", {OCC}, w AS ({dilated_sql(5, 5)}), n AS ({dilated_sql(2, 2)}) SELECT {MASK.format('TRUE')} FROM w SEMI JOIN cells USING (gy, gx) ANTI JOIN n USING (gy, gx)")
def a28(spark, d):
    cells = obstacle_grid(spark, d).withColumnRenamed("occupied", "blocked")
    return mask_sum(H.halo(cells, 2, 5).withColumn("on", F.lit(True)), "on")


LAYERS = "lay(scenario, layer, drop_) AS (VALUES " + ", ".join(f"({i}, '{n}', [{', '.join(repr(x) for x in g)}]::VARCHAR[])" for i, n, g in S.LAYERS) + ")"
LAYERED = f"""{OCC}, lc AS (SELECT gy, gx, label, count(*) AS n FROM (SELECT {bin_sql('5e-2')}, label FROM scan, meta, anc WHERE z BETWEEN a + 5e-2 AND a + 1e0) q GROUP BY ALL), lbl AS (SELECT gy, gx, label FROM (SELECT *, row_number() OVER (PARTITION BY gy, gx ORDER BY n DESC, label) AS k FROM lc) q WHERE k = 1),
    {NAMES}, {LAYERS}, bl AS (SELECT scenario, g.gy, g.gx, occ AND NOT coalesce(list_contains(drop_, fixation), FALSE) AS occ FROM grid g LEFT JOIN lbl USING (gy, gx) LEFT JOIN dim USING (label), lay),
    di AS (SELECT DISTINCT scenario, gy + a.i AS gy, gx + b.i AS gx FROM bl, range(-6, 7) a(i), range(-4, 5) b(i) WHERE occ), mask AS (SELECT scenario, gy, gx FROM bl ANTI JOIN di USING (scenario, gy, gx)),
    {cc_sql('mask', by='scenario')}, {largest_sql(by='scenario')},
    sc AS (SELECT scenario, count(*) FILTER (NOT occ) AS fl, count(big.gy) FILTER (NOT occ) AS acc FROM bl LEFT JOIN big USING (scenario, gy, gx) GROUP BY 1)"""


def scenario_cells(spark, d):
    """Dense cells per scenario; what is removed is floor from then on."""
    known = scan_facts(spark, d)
    grid = obstacle_grid(spark, d, known=known).select("gy", "gx", F.col("occupied").alias("was"))
    scenarios, dim = S.layer_scenarios(spark), S.label_dimension(spark)
    left = S.without_groups(grid.where("was").select("gy", "gx").join(labels(spark, d, known=known), ["gy", "gx"], "left"), scenarios, dim).withColumn("on", F.lit(True))
    dense = grid.join(F.broadcast(scenarios.select("scenario"))).join(left, ["scenario", "gy", "gx"], "left")
    return dense.select("scenario", "gy", "gx", F.coalesce("on", F.lit(False)).alias("blocked"), F.col("on").isNull().alias("floor"))


def scenario_scores(spark, d):
    cells = H.reach(scenario_cells(spark, d), 4, 6, "scenario")
    n = cells.groupBy("scenario").agg(*M.counted(acc=F.col("accessible"), fl=F.col("floor")))
    return n.select("scenario", (F.col("acc") * 0.0025).alias("accessible_area"), (100.0 * F.col("acc") / F.col("fl")).alias("rii"))


@query("d7_layered_scenarios", f", {LAYERED} SELECT scenario, round(acc * 25e-4, 6) AS accessible_area, round(100e0 * acc / fl, 6) AS rii, round(coalesce(100e0 * acc / fl - lag(100e0 * acc / fl) OVER (ORDER BY scenario), 0e0), 6) + 0e0 AS rii_gain, round(coalesce((acc - lag(acc) OVER (ORDER BY scenario)) * 25e-4, 0e0), 6) + 0e0 AS area_gain FROM sc", recursive=True)
def d7(spark, d):
    return rounded(H.layered(scenario_scores(spark, d)))


@query("d8_d10_removal_what_if", f", {LAYERED} SELECT scenario, acc AS reachable_cells FROM sc WHERE scenario IN (0, 2)", recursive=True)
def d8(spark, d):
    cells = H.reach(scenario_cells(spark, d).where("scenario IN (0, 2)"), 4, 6, "scenario")
    return cells.groupBy("scenario").agg(*M.counted(reachable_cells=F.col("accessible")))


@query(
    "d9_removal_candidates",
    f""", {BOTH}, {NAMES}, obj AS (SELECT label, g.gy, g.gx FROM grid g JOIN lbl USING (gy, gx) JOIN dim USING (label) WHERE occ AND fixation <> 'Fixed'), {cc_sql('obj', 'ob', by='label')},
    bx AS (SELECT r.label, c.l AS component, CAST(sum(r.b - r.a + 1) AS BIGINT) AS n, min(r.gy) AS y0, max(r.gy) AS y1, min(r.a) AS x0, max(r.b) AS x1 FROM obcc c JOIN obruns r USING (id) GROUP BY 1, 2 HAVING sum(r.b - r.a + 1) >= 16),
    lost AS (SELECT gy, gx FROM grid ANTI JOIN abig USING (gy, gx) WHERE NOT occ), un AS (SELECT b.*, (SELECT count(*) FROM lost WHERE gy BETWEEN b.y0 - 6 AND b.y1 + 6 AND gx BETWEEN b.x0 - 6 AND b.x1 + 6) AS u FROM bx b)
    SELECT row_number() OVER (ORDER BY priority, u DESC, n DESC, component) AS rank, label, name, fixation, n AS cells, round(n * 25e-4, 6) AS area, round(u * 25e-4, 6) AS unlock_area, y0, x0, y1, x1 FROM un JOIN dim USING (label) WHERE u > 0""",
    recursive=True,
)
def d9(spark, d):
    known = scan_facts(spark, d)
    cells = saved(reached(spark, d, 4, 6, obstacle_grid(spark, d, known=known)))
    return rounded(H.removal_candidates(cells, labels(spark, d, known=known), S.label_dimension(spark), 0.05, 6))


@query("j1_label_lookup", f", {NAMES} SELECT scan.label, coalesce(name, 'Label ' || scan.label) AS name, fixation, count(*) AS n FROM (SELECT CASE WHEN point_id % 50 = 0 THEN 16 ELSE label END AS label FROM scan) scan LEFT JOIN dim USING (label) GROUP BY ALL")
def j1(spark, d):
    df = scan(spark, d).withColumn("label", F.when(F.col("point_id") % 50 == 0, 16).otherwise(F.col("label")))
    counts = df.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(F.broadcast(S.label_dimension(spark)), "label", "left").select("label", F.coalesce("name", F.concat(F.lit("Label "), F.col("label"))).alias("name"), "fixation", "n")


@query("j2_label_semi_join", " SELECT label, count(*) AS n FROM scan WHERE label IN (1, 9, 13) GROUP BY 1")
def j2(spark, d):
    keep = spark.createDataFrame([(1,), (9,), (13,)], "label int")
    return scan(spark, d).join(F.broadcast(keep), "label", "left_semi").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("j9_boxes", ", b(id, x0, x1, y0, y1) AS (VALUES (1, 2e0, 25e-1, 2e0, 26e-1), (2, 4e0, 45e-1, 2e0, 26e-1), (3, 0e0, 1e1, 0e0, 5e-1)) SELECT id, count(*) AS n, round(sum(z), 3) AS sum_z FROM scan JOIN b ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 GROUP BY 1")
def j9(spark, d):
    boxes = spark.createDataFrame([(1, 2.0, 2.5, 2.0, 2.6), (2, 4.0, 4.5, 2.0, 2.6), (3, 0.0, 10.0, 0.0, 0.5)], "id int, x0 double, x1 double, y0 double, y1 double")
    hit = scan(spark, d).join(F.broadcast(boxes), F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1")))
    return rounded(hit.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.sum("z").alias("sum_z")), 3)


PARTS = "pt AS (SELECT label, avg(CASE WHEN z <= 1e0 THEN 1e0 ELSE 0e0 END) AS tcr, avg(CASE WHEN x <= 5e0 THEN 1e0 ELSE 0e0 END) AS oe, avg(CASE WHEN y <= 3e0 THEN 1e0 ELSE 0e0 END) AS sc, 100e0 * avg(CASE WHEN z BETWEEN 5e-2 AND 15e-1 THEN 1e0 ELSE 0e0 END) AS rii_h FROM scan GROUP BY 1)"


@query("a27_d14_combined_score", f", {PARTS} SELECT label, round(rii_h, 6) AS rii_h, round(tcr, 6) AS tcr, round(oe, 6) AS oe, round(sc, 6) AS sc, round(tcr * (5e-1 * oe + 5e-1 * sc) * 100, 6) + 0e0 AS combined, round(5e-1 * rii_h + 5e-1 * tcr * 100, 6) AS weighted FROM pt")
def a27(spark, d):
    """The combined scores of shares that are taken of the points of every label."""
    share = lambda test: F.avg(F.when(test, 1.0).otherwise(0.0))
    parts = scan(spark, d).groupBy("label").agg(
        share(F.col("z") <= 1.0).alias("tcr"), share(F.col("x") <= 5.0).alias("oe"), share(F.col("y") <= 3.0).alias("sc"), (100.0 * share(F.col("z").between(0.05, 1.5))).alias("rii_h")
    )
    return rounded(M.combined(parts))


OPENED = f"""open_ AS (SELECT g.gy, g.gx, occ AND NOT coalesce(fixation <> 'Fixed', FALSE) AS occ FROM grid g LEFT JOIN lbl USING (gy, gx) LEFT JOIN dim USING (label)), {reach_sql(1, 1, 'v').replace('FROM grid', 'FROM open_')},
    lost AS (SELECT gy, gx FROM vbig ANTI JOIN abig USING (gy, gx)), mc AS (SELECT gy, gx, label, count(*) AS n FROM (SELECT {bin_sql('5e-2')}, label FROM scan, meta) q GROUP BY ALL),
    own AS (SELECT gy, gx, label FROM lost JOIN (SELECT gy, gx, label FROM mc QUALIFY row_number() OVER (PARTITION BY gy, gx ORDER BY n DESC, label) = 1) ml USING (gy, gx)),
    og AS (SELECT coalesce(n.label, -1) AS label, coalesce(name, 'No semantic data') AS name, coalesce(fixation, 'Unknown') AS fixation, coalesce(priority, 4) AS priority, count(*) AS cells FROM lost LEFT JOIN own n USING (gy, gx) LEFT JOIN dim ON dim.label = n.label WHERE name IS NOT NULL OR n.label IS NULL GROUP BY 1, 2, 3, 4)"""


@query("t1_recommendations", f", {BOTH}, {NAMES}, {OPENED} SELECT * FROM (SELECT label, name, fixation, cells, row_number() OVER (ORDER BY priority, cells DESC, label) AS rank FROM og WHERE label NOT IN (-1, 0, 1)) q WHERE rank <= 3", recursive=True)
def t1(spark, d):
    """What to clear first of the floor that the robot misses against the site without things that can be moved."""
    grid, named = obstacle_grid(spark, d), S.label_dimension(spark).where("fixation <> 'Fixed'").select("label")
    things = labels(spark, d).join(F.broadcast(named), "label", "left_semi").select("gy", "gx", F.lit(True).alias("thing"))
    opened = saved(grid.join(things, ["gy", "gx"], "left").withColumn("occupied", F.col("occupied") & F.col("thing").isNull()).drop("thing"))
    ref = reached(spark, d, 1, 1, opened).where("accessible").select("gy", "gx")
    missed = saved(ref.join(reached(spark, d, 4, 6, grid).where("accessible").select("gy", "gx"), ["gy", "gx"], "left_anti"))
    return S.recommendations(S.gap_by_label(missed, map_labels(spark, d), S.label_dimension(spark), 0.0025)).select("label", "name", "fixation", "cells", "rank")
