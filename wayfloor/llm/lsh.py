"""Classes of similar sets from banded signatures, with every link verified exactly.

The members of a bucket (a band value) are compared with the bucket's leader,
its least node; what is linked by then is not compared again.  Members that
their leader's component does not hold are compared with all of the bucket, in
blocks, so that no link between components is lost.  No bucket is expanded into
its pairs, and none is gathered in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfloor.llm.common import connected_components, discard, groups, materialize, small


#: Sets of a block, about: a set is moved once for every block of the other side.
BLOCK = 256


def bands_for(threshold: float, rows: int, miss: float) -> int:
    """How many bands of ``rows`` rows find a pair at the threshold but for a chance of ``miss``."""
    return int(np.ceil(np.log(miss) / np.log(1 - threshold**rows)))


def jaccard_pairs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs(a, b)`` with ``similarity``, from ``sets(node, shingles binary)`` of sorted 64-bit values."""
    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    rows = pairs.select("a", "b").join(two, "b").join(one, "a").select("a", "b", "sa", "sb")

    def run(batches):
        for batch in small(batches):
            out = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                same = int((y[np.minimum(at, len(y) - 1)] == x).sum()) if len(y) else 0
                out.append(same / max(1, len(x) + len(y) - same))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())], names=["a", "b", "similarity"])

    return rows.mapInArrow(run, "a long, b long, similarity double")


def link_classes(nodes: DataFrame, fetch, threshold: float) -> DataFrame:
    """``nodes(node long, bands array<long>)`` -> components ``(id, component)`` of the links at the threshold.

    ``fetch(ids)`` returns ``(node, shingles)`` for a DataFrame of node ids.
    Nodes without a link are in no component.
    """
    flat = nodes.select("node", F.explode("bands").alias("band"))
    leaders = flat.groupBy("band").agg(F.min("node").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1").select("band", "leader")
    members = materialize(flat.join(leaders, "band").where("node <> leader").select("band", "leader", "node"), "members")
    ids = members.select("node").union(members.select(F.col("leader").alias("node"))).distinct()
    sets = materialize(fetch(ids), "sets")

    # First every node with its least leader alone: that joins the copies of a text, however many buckets they share.
    pairs = members.groupBy(F.col("node").alias("b")).agg(F.min("leader").alias("a"))
    compared = materialize(jaccard_pairs(pairs, sets), "compared")
    labels = connected_components(compared.where(F.col("similarity") >= threshold).select("a", "b"))

    # Then with the leaders that are still in other components.
    placed = _placed(members, labels)
    pairs = placed.where("component <> home").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    more = materialize(jaccard_pairs(pairs.join(compared, ["a", "b"], "left_anti"), sets).where(F.col("similarity") >= threshold), "compared")
    labels = _joined(labels, more)

    # Last the members of a bucket that its leader's component does not hold, with all of the bucket, in blocks.
    placed = materialize(_placed(members, labels), "placed")
    discard(members, compared)
    mixed = placed.where("component <> home").select("band").distinct()
    if not mixed.limit(1).count():
        discard(placed, sets)
        return labels
    here = placed.select("band", "node", "component", F.expr("component <> home").alias("apart")).join(mixed, "band", "left_semi")
    late = materialize(_block_links(here, sets, threshold), "late-links")
    discard(placed, sets)
    return _joined(labels, late)


def _joined(labels: DataFrame, found: DataFrame) -> DataFrame:
    """``labels`` after more links ``found(a, b)``: only the graph of components is labelled anew."""
    if not found.limit(1).count():
        return labels
    of = lambda end: labels.select(F.col("id").alias(end), F.col("component").alias(f"of_{end}"))
    ends = found.select("a", "b").join(of("a"), "a", "left").join(of("b"), "b", "left")
    ends = materialize(ends.select("a", "b", F.coalesce("of_a", "a").alias("of_a"), F.coalesce("of_b", "b").alias("of_b")), "ends")
    top = connected_components(ends.select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))).select(F.col("id").alias("component"), F.col("component").alias("top"))
    fresh = ends.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(labels, "id", "left_anti").select("id", F.col("id").alias("component"))
    whole = labels.unionByName(fresh).join(top, "component", "left")
    return materialize(whole.select("id", F.coalesce("top", "component").alias("component")), "labels")


def _block_links(members: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links that join components, of ``members(band, node, component, apart)``: those apart against all of their bucket.

    Both sides are dealt into blocks of about ``BLOCK`` sets and every pair of
    blocks is a group of its own, so a bucket's work is spread over tasks and a
    set is moved once a block, not once a pair.
    """
    counts = materialize(members.groupBy("band").agg(F.count(F.lit(1)).alias("m"), F.sum(F.col("apart").cast("long")).alias("q")), "counts")
    rows, columns = F.ceil(F.col("m") / BLOCK), F.ceil(F.col("q") / BLOCK)
    at = members.join(counts, "band")
    block = F.abs(F.hash("node").cast("long"))
    sides = at.select("band", "node", "component", F.lit(0).alias("side"), (block % rows).alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), columns - 1)).alias("j"))
    sides = sides.unionByName(
        at.where("apart").select("band", "node", "component", F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0).cast("long"), rows - 1)).alias("i"), (block % columns).alias("j"))
    )
    dealt = sides.join(sets, "node").select("band", "i", "j", "side", "node", "component", "shingles")

    def run(batches):
        for group in groups(batches, 3):
            rows = group.to_pylist()
            out = _joining([r for r in rows if not r["side"]], [r for r in rows if r["side"]], threshold)
            yield pa.RecordBatch.from_arrays([pa.array([v[i] for v in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return dealt.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j").mapInArrow(run, "a long, b long").distinct()


def _joining(xs: list[dict], ys: list[dict], threshold: float) -> list[tuple[int, int]]:
    """Of the links between two blocks, enough to join the components that they join."""
    of = {}

    def root(c):
        while of.setdefault(c, c) != c:
            of[c] = c = of[of[c]]
        return c

    if not xs or not ys:
        return []
    y_sets = [np.frombuffer(y["shingles"], np.uint64) for y in ys]
    size = np.array([len(s) for s in y_sets])
    values = np.concatenate(y_sets)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], np.repeat(np.arange(len(ys)), size)[order]
    out = []
    for x in xs:
        s = np.frombuffer(x["shingles"], np.uint64)
        lo, hi = np.searchsorted(values, s), np.searchsorted(values, s, side="right")
        width = hi - lo
        at = np.repeat(lo - np.concatenate(([0], np.cumsum(width)[:-1])), width) + np.arange(width.sum())
        same = np.bincount(owner[at], minlength=len(ys))
        for j in np.flatnonzero(same >= threshold * (len(s) + size - same)).tolist():
            if root(x["component"]) != root(ys[j]["component"]):
                of[root(x["component"])] = root(ys[j]["component"])
                out.append((min(x["node"], ys[j]["node"]), max(x["node"], ys[j]["node"])))
    return out


def _placed(members: DataFrame, labels: DataFrame) -> DataFrame:
    """``members`` with the component of the node and of its leader (home)."""
    label = labels.select(F.col("id").alias("node"), "component")
    home = labels.select(F.col("id").alias("leader"), F.col("component").alias("home"))
    placed = members.join(label, "node", "left").join(home, "leader", "left")
    return placed.select("band", "leader", "node", F.coalesce("component", "node").alias("component"), F.coalesce("home", "leader").alias("home"))
