"""Sequential rules of the scan against plain versions: greedy segments, cross-section ramps, continuity."""

import math
import random
import statistics
from collections import deque

import pytest

from wayfloor.operators import grid as G
from wayfloor.operators import ramps as R
from wayfloor.operators import vertical as V


def line(pts):
    n = len(pts)
    mx, mz = sum(p[0] for p in pts) / n, sum(p[1] for p in pts) / n
    sxx, szz, sxz = sum((x - mx) ** 2 for x, _ in pts), sum((z - mz) ** 2 for _, z in pts), sum((x - mx) * (z - mz) for x, z in pts)
    return (sxz / sxx if sxx else 0.0), (1.0 if szz < 1e-12 else sxz * sxz / sxx / szz)


def plain_segments(pts):
    out, i = [], 0
    while i + 3 <= len(pts):
        j = i + 3
        while j < len(pts) and line(pts[i : j + 1])[1] >= 0.85:
            j += 1
        slope, r2 = line(pts[i:j])
        out.append((pts[i][0], pts[j - 1][0], round(slope, 9), round(r2, 9), abs(slope) < 0.05))
        i = j - 1
    return out


def test_greedy_segments(spark):
    rng = random.Random(3)
    rows, want = [], []
    for strip in range(12):
        pts, z, slope = [], 0.0, 0.0
        for i in range(rng.choice([2, 3, 4, 30])):
            if rng.random() < 0.2:
                slope = rng.choice([0.0, 0.0, 0.2, -0.3])
            z += slope * 0.2 + rng.gauss(0, 0.002)
            pts.append((i * 0.2, z))
        rows += [(strip, x, z) for x, z in pts]
        want += [(strip, i, *seg) for i, seg in enumerate(plain_segments(pts))]
    got = R.greedy_segments(spark.createDataFrame(rows, "strip long, x double, z double")).collect()
    assert sorted((r.strip, r.segment, r.x0, r.x1, round(r.slope, 9), round(r.r2, 9), r.is_flat) for r in got) == want


def test_profile_ramps_have_a_flat_side(spark):
    rows = [(1, i * 0.2, 0.0 if i < 6 else (i - 5) * 0.05 if i < 16 else 0.5) for i in range(22)] + [(2, i * 0.2, i * 0.05) for i in range(20)]
    got = R.profile_ramps(R.greedy_segments(spark.createDataFrame(rows, "strip long, x double, z double"))).collect()
    assert {r.strip for r in got} == {1} and all(r.angle >= 4 and r.length >= 1 for r in got)


def plain_refined(pts, r):
    x0, x1, y0, y1 = min(r.wx0, r.wx1) - 2, max(r.wx0, r.wx1) + 2, min(r.wy0, r.wy1) - 2, max(r.wy0, r.wy1) + 2
    long = math.hypot(r.wx1 - r.wx0, r.wy1 - r.wy0)
    ux, uy, cx, cy = (r.wx1 - r.wx0) / long, (r.wy1 - r.wy0) / long, (r.wx0 + r.wx1) / 2, (r.wy0 + r.wy1) / 2
    at = [((x - cx) * ux + (y - cy) * uy, (y - cy) * ux - (x - cx) * uy, z) for x, y, z in pts if x0 <= x <= x1 and y0 <= y <= y1]
    u0 = min(u for _, u, _ in at)
    angles = []
    for i in range(max(1, int((max(u for _, u, _ in at) - u0) / 0.5))):
        strip = [(t, z) for t, u, z in at if math.floor((u - u0) / 0.5) == i]
        if len(strip) < 10:
            continue
        t0 = min(t for t, _ in strip)
        bins = {}
        for t, z in strip:
            bins.setdefault(math.floor((t - t0) / 0.15), []).append(z)
        most = max(1, int((max(t for t, _ in strip) - t0) / 0.15))
        line_ = [(t0 + (b + 0.5) * 0.15, statistics.quantiles(sorted(v), n=10, method="inclusive")[0]) for b, v in sorted(bins.items()) if b < most and len(v) >= 3]
        if len(line_) >= 4:
            slope, r2 = line(line_)
            if r2 >= 0.5 and max(z for _, z in line_) - min(z for _, z in line_) > 1e-6:
                angles.append(math.degrees(math.atan(abs(slope))))
    return statistics.median(angles) if angles else r.angle


@pytest.mark.parametrize("heading", [0, 45, 90, 135, 180])
def test_a_ramp_is_found_whichever_way_it_runs(spark, heading):
    """Floor, a ramp of 3 m that rises 0.6 m, and a deck: one ramp, at its angle, with its ends along the heading."""
    rng = random.Random(heading)
    c, s = math.cos(math.radians(heading)), math.sin(math.radians(heading))
    pts = []
    for _ in range(24000):
        t, u = rng.uniform(-6, 8), rng.uniform(-2, 2)
        pts.append((t * c - u * s, t * s + u * c, min(max(t, 0.0), 3.0) * 0.2))
    df = spark.createDataFrame(pts, "x double, y double, z double")
    found = R.section_ramps(df).withColumnRenamed("cluster", "ramp")
    rows = R.refined_angles(found, df).collect()
    assert len(rows) == 1
    (r,) = rows
    # Greedy segments reach onto the floor and slanted headings see less slope, so the mean angle is under that of the ramp.
    assert r.n >= 3 and 5 < r.angle < math.degrees(math.atan(0.2)) + 1 and r.traversable
    assert abs(r.refined - plain_refined(pts, r)) < 1e-6
    assert abs(math.hypot(r.wx1 - r.wx0, r.wy1 - r.wy0) - r.length) < 1e-9 and 2 < r.length < 5 and 0.4 < r.rise <= 0.7


def test_clusters_are_greedy_and_not_transitive(spark):
    rows = [(0, float(i), float(i), float(i), 5.0, 0.5, 1.0, 0.9, x, 0.0, x, 0.0) for i, x in enumerate([0.0, 2.0, 4.0, 6.0, 20.0])]
    schema = "heading int, strip_y double, x0 double, x1 double, angle double, rise double, length double, r2 double, wx0 double, wy0 double, wx1 double, wy1 double"
    got = R.radius_clusters(spark.createDataFrame(rows, schema), 3.0).collect()
    assert {r.wx0: r.cluster for r in got} == {0.0: 0, 2.0: 0, 4.0: 2, 6.0: 2, 20.0: 4}


def test_continuity_is_the_largest_solid_component(spark):
    rng = random.Random(1)
    cells = {(rng.randrange(9), rng.randrange(9), rng.randrange(9)) for _ in range(260)}
    left, sizes = set(cells), []
    while left:
        ring, n = deque([left.pop()]), 1
        while ring:
            z, y, x = ring.popleft()
            for c in ((z + 1, y, x), (z - 1, y, x), (z, y + 1, x), (z, y - 1, x), (z, y, x + 1), (z, y, x - 1)):
                if c in left:
                    left.discard(c)
                    ring.append(c)
                    n += 1
        sizes.append(n)
    (r,) = V.continuity(spark.createDataFrame(list(cells), "vz long, vy long, vx long")).collect()
    assert (r.components, r.largest, r.painted) == (len(sizes), max(sizes), len(cells))


def test_holes_are_filled_round_by_round_around_the_map(spark):
    rng = random.Random(2)
    h, w = 7, 9
    z = {(y, x): rng.random() if rng.random() < 0.3 else None for y in range(h) for x in range(w)}
    meta = spark.createDataFrame([(w, h)], "width long, height long")
    got = G.fill_holes(spark.createDataFrame([(y, x, v) for (y, x), v in z.items()], "gy long, gx long, z double"), 3, meta).collect()
    for _ in range(3):
        new = dict(z)
        for (y, x), v in z.items():
            near = [z[(y + a) % h, (x + b) % w] for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1))]
            near = [n for n in near if n is not None]
            if v is None and near:
                new[y, x] = sum(near) / len(near)
        z = new
    assert all((r.z is None) == (z[r.gy, r.gx] is None) and (r.z is None or abs(r.z - z[r.gy, r.gx]) < 1e-12) for r in got) and len(got) == h * w
