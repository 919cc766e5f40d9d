"""Spanning trees, list ranking and tours against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from wayfloor.operators.tours import ranked, spanning_forest, tree_tours


def parts(nodes, edges):
    of = {n: n for n in nodes}

    def root(n):
        while of[n] != n:
            n = of[n]
        return n

    tree = []
    for s, t in sorted(edges):
        if root(s) != root(t):
            of[root(s)] = root(t)
            tree.append((s, t))
    return tree


@pytest.mark.parametrize("seed", range(3))
def test_forest_is_that_of_least_edges(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(40), rng.randrange(40)) for _ in range([30, 60, 150][seed])]
    got = spanning_forest(spark.createDataFrame(edges + edges[:4], "s long, t long")).collect()
    least = {(min(e), max(e)) for e in edges if e[0] != e[1]}
    assert sorted((r.s, r.t) for r in got) == parts(range(40), least)


def test_ranks(spark):
    rng = random.Random(1)
    ids = rng.sample(range(1000), 60)
    links, want = [], {}
    for chunk in (ids[:1], ids[1:18], ids[18:]):
        links += [(a, b) for a, b in zip(chunk, chunk[1:])] + [(chunk[-1], None)]
        want |= {a: len(chunk) - 1 - i for i, a in enumerate(chunk)}
    rng.shuffle(links)
    assert {r.id: r.behind for r in ranked(spark.createDataFrame(links, "id long, next long")).collect()} == want


def largest(cells):
    left, best = set(cells), set()
    for c in sorted(cells):
        if c in left:
            part, ring = {c}, [c]
            while ring:
                ring = [n for y, x in ring for n in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)) if n in left and n not in part and not part.add(n)]
            left -= part
            best = part if len(part) > len(best) else best
    return best


def test_tours_of_random_maps(spark):
    rng = random.Random(4)
    rows = [(m, y, x) for m, p in ((0, 0.7), (1, 0.9), (5, 0.5)) for y in range(9) for x in range(11) if rng.random() < p] + [(7, 3, 3)]
    got = tree_tours(spark.createDataFrame(rows + rows[:5], "map_id int, gy int, gx int").withColumn("seq", F.lit("other")).repartition(6)).collect()
    for m in (0, 1, 5, 7):
        want = largest({(y, x) for q, y, x in rows if q == m})
        walk = [(r.gy, r.gx) for r in sorted((r for r in got if r.map_id == m), key=lambda r: r.seq)]
        assert [r.seq for r in sorted((r for r in got if r.map_id == m), key=lambda r: r.seq)] == list(range(2 * len(want) - 1))
        assert set(walk) == want and walk[0] == min(want) == walk[-1]
        assert all(abs(a[0] - b[0]) + abs(a[1] - b[1]) == 1 for a, b in zip(walk, walk[1:]))
    assert tree_tours(spark.createDataFrame(rows, "map_id int, gy int, gx int").limit(0)).count() == 0
