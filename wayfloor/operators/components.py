"""Connected components of cell sets, 4-connected, or 6-connected in space.

Cells are first contracted to runs along x with a window function; runs of
neighbouring rows that overlap are edges.  Least labels spread along the edges
with pointer jumping, so the number of rounds grows with the logarithm of a
component's length, and the data of a round with the number of runs.  The
component of a cell is named by the least cell, row by row.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfloor.functions.shared import discard, saved

#: Row pitch of cell numbers; columns are below it.
PITCH = 1 << 24


def runs(cells: DataFrame, rows: list[str], along: str = "gx") -> DataFrame:
    """Maximal runs ``(rows, a, b)`` of consecutive cells."""
    island = F.col(along) - F.row_number().over(Window.partitionBy(*rows).orderBy(along))
    return cells.select(*rows, along).distinct().withColumn("__g", island).groupBy(*rows, "__g").agg(F.min(along).alias("a"), F.max(along).alias("b")).drop("__g")


#: Edges up to which a map's labels are found in one task instead of in rounds.
LOCAL_EDGES = 200_000


def _labelled_in_one_task(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The same labels by union-find over rows of a checked, small number."""
    rows = nodes.select(F.col("id").alias("s"), F.col("id").alias("t")).unionByName(edges.select("s", "t")).coalesce(1)

    def run(batches):
        parent: dict[int, int] = {}

        def root(i):
            top = i
            while parent[top] != top:
                top = parent[top]
            while parent[i] != top:
                parent[i], i = top, parent[i]
            return top

        for batch in batches:
            for s, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parent.setdefault(s, s)
                parent.setdefault(t, t)
                a, b = root(s), root(t)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        ids = list(parent)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([root(i) for i in ids], pa.int64())], names=["id", "label"])

    return rows.mapInArrow(run, "id long, label long")


def spread_labels(nodes: DataFrame, edges: DataFrame, local_edges: int = 0, max_rounds: int = 64) -> DataFrame:
    """``nodes(id)``, ``edges(s, t)`` both ways -> ``(id, label)`` with the least id of each component.

    Every node points at a label, at first the least of itself and its
    neighbours.  A round takes the least label of the labels of a node's neighbours, for the node and for the node it
    points at, and shortens pointers to pointers: trees are joined at their
    roots, so the rounds grow with the logarithm of a component's length.  All
    steps are joins and minima with partial aggregation.
    """
    edges = edges if getattr(edges, "_saved_at", None) else saved(edges.select("s", "t"))
    if local_edges and edges.count() <= local_edges and nodes.count() <= local_edges:
        return _labelled_in_one_task(nodes, edges)
    least = nodes.select("id", F.col("id").alias("label")).union(edges.select(F.col("t").alias("id"), F.col("s").alias("label"))).groupBy("id").agg(F.min("label").alias("label"))
    labels = table = saved(least)
    for _ in range(max_rounds):
        up = labels.select(F.col("id").alias("label"), F.col("label").alias("up"))
        high = saved(labels.join(up, "label").select("id", "label", "up"))
        heard = edges.join(high.select(F.col("id").alias("s"), "up"), "s").groupBy(F.col("t").alias("id")).agg(F.min("up").alias("heard"))
        joined = high.join(heard, "id", "left").withColumn("heard", F.coalesce("heard", "label"))
        # What a node hears is for the node it points at, too.
        offers = joined.select(F.col("label").alias("id"), F.col("heard").alias("best")).union(joined.select("id", F.least("label", "up", "heard").alias("best")))
        best = offers.groupBy("id").agg(F.min("best").alias("best"))
        new = saved(labels.join(best, "id").select("id", F.least("label", "best").alias("label"), F.col("label").alias("old")))
        moved = new.where("label <> old").limit(1).count()
        discard(high, table)
        table, labels = new, new.select("id", "label")
        if not moved:
            return labels
    raise RuntimeError("labels did not settle; raise max_rounds")


#: The number of the source that leads to all seeds; below all node numbers.
SOURCE = -1


def reached(edges: DataFrame, seeds: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """Nodes ``(id)`` that are reached from ``seeds(id)`` over directed ``edges(s, t)``; node numbers are not negative.

    Nodes that are reached together are contracted until nothing leads out of
    the source any more: the ends of edges both ways, a node and its only
    predecessor, the source and what it leads to.  A graph of edges both ways is
    done in one round, a long one-way lane in one round as well, since a class
    is found by labels that spread in logarithmically many steps.
    """
    ends = saved(seeds.select(F.lit(SOURCE).cast("long").alias("s"), F.col("id").alias("t")).unionByName(edges.select("s", "t")).where("s <> t").distinct())
    classes = None
    for _ in range(max_rounds):
        if not ends.where(F.col("s") == SOURCE).limit(1).count():
            break
        back = ends.select(F.col("t").alias("s"), F.col("s").alias("t"))
        only = ends.groupBy("t").agg(F.count(F.lit(1)).alias("n"), F.max("s").alias("s")).where("n = 1").select("s", "t")
        merged = ends.where(F.col("s") == SOURCE).unionByName(ends.join(back, ["s", "t"], "left_semi")).unionByName(only)
        both = saved(merged.unionByName(merged.select(F.col("t").alias("s"), F.col("s").alias("t"))).distinct())
        labels = saved(spread_labels(both.select(F.col("s").alias("id")).distinct(), both, LOCAL_EDGES))
        if classes is None:
            new = labels.select("id", F.col("label").alias("class"))
        else:
            own = classes.join(labels.select(F.col("id").alias("class"), "label"), "class", "left").select("id", F.coalesce("label", "class").alias("class"))
            new = own.unionByName(labels.join(classes, "id", "left_anti").select("id", F.col("label").alias("class")))
        new = saved(new)
        of = lambda end: labels.select(F.col("id").alias(end), F.col("label").alias(f"of_{end}"))
        led = ends.join(of("s"), "s", "left").join(of("t"), "t", "left").select(F.coalesce("of_s", "s").alias("s"), F.coalesce("of_t", "t").alias("t"))
        led = saved(led.where(F.col("s") != F.col("t")).where(F.col("t") != SOURCE).distinct())
        discard(both, labels, ends, *([classes] if classes is not None else []))
        ends, classes = led, new
    else:
        raise RuntimeError("classes did not settle; raise max_rounds")
    return seeds.select("id").limit(0) if classes is None else classes.where((F.col("class") == SOURCE) & (F.col("id") != SOURCE)).select("id")


def components(cells: DataFrame, space: bool = False, by: str | None = None) -> DataFrame:
    """``(gy, gx)`` cells, or ``(vz, gy, gx)`` with ``space``, with ``component``.

    ``by`` names a small integer column (map, scenario, level): components stay
    inside one value of it, and all values are labelled in the same rounds.
    """
    rows = [*([by] if by else []), *(["vz"] if space else []), "gy"]
    number = F.col("gy") * PITCH + F.col("a")
    if space:
        number = (F.col("vz") * (1 << 19) + F.col("gy")) * (1 << 19) + F.col("a")
    if by:
        number = F.col(by).cast("long") * (1 << 57 if space else 1 << 48) + number
    r = saved(runs(cells, rows).withColumn("id", number))
    other = r.select(*(F.col(c).alias(f"{c}2") for c in (*rows, "a", "b", "id")))
    touch = (F.col("a") <= F.col("b2")) & (F.col("a2") <= F.col("b"))
    if by:
        touch = touch & (F.col(by) == F.col(f"{by}2"))
    pairs = r.join(other, (F.col("gy2") == F.col("gy") + 1) & touch & (F.col("vz2") == F.col("vz") if space else F.lit(True)))
    if space:
        pairs = pairs.unionByName(r.join(other, (F.col("vz2") == F.col("vz") + 1) & (F.col("gy2") == F.col("gy")) & touch))
    edges = pairs.select(F.explode(F.array(F.struct(F.col("id").alias("s"), F.col("id2").alias("t")), F.struct(F.col("id2").alias("s"), F.col("id").alias("t")))).alias("e")).select("e.*")
    labels = spread_labels(r, edges, LOCAL_EDGES)
    named = labels.select("id", F.col("label").alias("component"))
    return r.join(named, "id").select(*rows, F.explode(F.sequence("a", "b")).alias("gx"), "component")


def sizes(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("component").agg(F.count(F.lit(1)).alias("n"))


def largest(labelled: DataFrame, by: str | None = None) -> DataFrame:
    """The cells of the largest component (of every value of ``by``); of equal ones the first, row by row."""
    keys = [by] if by else []
    n = labelled.groupBy(*keys, "component").agg(F.count(F.lit(1)).alias("n"))
    best = n.groupBy(*keys).agg(F.max(F.struct("n", (-F.col("component")).alias("c"))).alias("m")).select((-F.col("m.c")).alias("component"))
    return labelled.join(best, "component", "left_semi")


def drop_small(labelled: DataFrame, least: int) -> DataFrame:
    return labelled.join(sizes(labelled).where(F.col("n") >= least), "component", "left_semi")


def _distances_in_one_task(cells: DataFrame, start: DataFrame) -> DataFrame:
    """The same walk lengths for a map of a checked, small size."""
    flagged = cells.join(start.select("gy", "gx").distinct().withColumn("on", F.lit(True)), ["gy", "gx"], "left")
    rows = flagged.select(F.col("gy").cast("long").alias("gy"), F.col("gx").cast("long").alias("gx"), F.coalesce("on", F.lit(False)).alias("on")).coalesce(1)

    def run(batches):
        free, ring = set(), []
        for batch in batches:
            for y, x, on in zip(*(c.to_pylist() for c in batch.columns)):
                free.add((y, x))
                if on:
                    ring.append((y, x))
        out, d = [], 0
        free.difference_update(ring)
        while ring:
            out += [(y, x, d) for y, x in ring]
            nxt = {c for y, x in ring for c in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)) if c in free}
            free -= nxt
            ring, d = list(nxt), d + 1
        kinds = (pa.int64(), pa.int64(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["gy", "gx", "d"])

    return rows.mapInArrow(run, "gy long, gx long, d int")


def distances(cells: DataFrame, start: DataFrame, max_rounds: int = 100_000) -> DataFrame:
    """Steps of 4-neighbour walks from the ``start`` cells inside ``cells``; the frontier alone is joined in each round."""
    cells = saved(cells.select("gy", "gx").distinct())
    if cells.count() <= LOCAL_EDGES:
        return _distances_in_one_task(cells, start)
    frontier = saved(start.join(cells, ["gy", "gx"], "left_semi").select("gy", "gx").distinct())
    seen = saved(frontier.withColumn("d", F.lit(0)))
    steps = F.array(*(F.struct(F.lit(y).alias("dy"), F.lit(x).alias("dx")) for y, x in ((1, 0), (-1, 0), (0, 1), (0, -1))))
    for d in range(1, max_rounds):
        moved = frontier.select("gy", "gx", F.explode(steps).alias("s")).select((F.col("gy") + F.col("s.dy")).alias("gy"), (F.col("gx") + F.col("s.dx")).alias("gx"))
        frontier = saved(moved.distinct().join(cells, ["gy", "gx"], "left_semi").join(seen, ["gy", "gx"], "left_anti"))
        if not frontier.limit(1).count():
            return seen
        seen = seen.unionByName(frontier.withColumn("d", F.lit(d)))
        if d % 16 == 0:
            seen = saved(seen)
    raise RuntimeError("walks did not end; raise max_rounds")
