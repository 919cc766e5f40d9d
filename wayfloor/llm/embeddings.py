"""Near-duplicate embeddings by iterative quantisation (operator 10).

A rotation of the principal axes is learned so that the signs of the rotated
vectors are balanced bits that lie close to the vectors; more bits than
dimensions take further rotations.  The codes are cut into substrings, one hash
table each, and vectors that agree on a substring meet.  Substrings grow with
the table, so that a lookup finds about as many strangers at any size, and the
number of tables grows with their width, so that a pair at the threshold is
missed with a chance of ``MISS`` at any size (at a common mean of norm 0.8;
without one far more seldom).  What meets and has short codes within
``MAX_HAMMING`` bits is ranked again with the original vectors, by cosine in
double precision.

A key of more than ``HOT`` vectors is not expanded into pairs: its vectors are
dealt into a grid of blocks, and a block of products yields sums of links and
the links that join components.  Two vectors that share several such keys are
compared at the least of them.

The rotation is fitted on at most ``FIT_ROWS`` vectors (in expectation), chosen
by a hash; every vector is indexed and looked up.

Vectors that repeat whole under one label are one node with a count, so copies
are never paired.

Defined cases: vectors that are null, zero, or hold null or non-finite
components link with nothing, nor do those without a label; vectors of
different length never link; repeated rows link with each other; ids may repeat.
Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfloor.llm.common import connected_components, groups, materialize, small

THRESHOLD = 0.98
#: Bits of the short code that candidates are filtered by, and by how many they may differ.
BITS, MAX_HAMMING = 64, 20
#: Bound of the sample that the rotation is fitted on, and rounds of the fitting.
FIT_ROWS, FIT_ROUNDS = 10_000, 20
#: A substring has so many bits fewer than the logarithm of the number of vectors of a label.
SLACK_BITS = 1
#: How often a bit differs at the threshold: the angle of such vectors seen from a common mean of norm 0.8.
MEAN_NORM, MISS = 0.8, 0.05
#: Vectors of a key beyond which it is compared in blocks, and of a block.
HOT, BLOCK = 256, 256


def learn_rotation(x: np.ndarray, bits: int = BITS, rounds: int = FIT_ROUNDS, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """Mean and projection (dimension x bits) of unit vectors.  More bits than dimensions take further random rotations."""
    rng = np.random.default_rng(seed)
    d = x.shape[1]
    if not len(x):
        return np.zeros(d), rng.normal(size=(d, bits))
    mean = x.mean(axis=0)
    _, axes = np.linalg.eigh((x - mean).T @ (x - mean))
    parts, left = [], bits
    while left > 0:
        c = min(d, left)
        w = axes[:, ::-1][:, :c]
        v = (x - mean) @ w
        r, _ = np.linalg.qr(rng.normal(size=(c, c)))
        for _ in range(rounds):
            code = np.where(v @ r >= 0, 1.0, -1.0)
            u, _, vt = np.linalg.svd(code.T @ v)
            r = (u @ vt).T
        parts.append(w @ r)
        left -= c
    return mean, np.concatenate(parts, axis=1)


def tables(vectors: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """(width, number) of the substrings for so many vectors."""
    width = int(np.clip(np.ceil(np.log2(max(2, vectors))) - SLACK_BITS, 8, 40))
    differs = np.arccos(max(-1.0, 1 - (1 - threshold) / (1 - MEAN_NORM**2))) / np.pi
    return width, max(-(-BITS // width), int(np.ceil(np.log(MISS) / np.log(1 - (1 - differs) ** width))))


def codes_of(x: np.ndarray, mean: np.ndarray, projection: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(short code, keys): the first 64 sign bits, and all of them cut into substrings, as signed integers."""
    bits = (x - mean) @ projection >= 0
    pack = lambda part: (part.astype(np.uint64) << np.arange(part.shape[-1], dtype=np.uint64)).sum(axis=-1, dtype=np.uint64).view(np.int64)
    return pack(bits[:, :BITS]), pack(bits.reshape(len(x), -1, width))


def _matrix(column, width: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, width)


def _nodes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(vec_id, embedding, label)`` -> rows ``(vec_id, node)`` and nodes ``(node, label, v, n, least)``.

    A node stands for all rows with one vector and label; its row is null where nothing can be linked.
    """
    ok = F.coalesce(
        (F.size("v") > 0) & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))) & F.exists("v", lambda c: c != 0) & F.col("label").isNotNull(),
        F.lit(False),
    )
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v"), F.col("label")).withColumn("ok", ok)
    rows = rows.withColumn("node", F.when(F.col("ok"), F.xxhash64("label", "v", F.size("v"))))
    same = rows.where("ok").groupBy("node").agg(F.first("label").alias("label"), F.first("v").alias("v"), F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least"))
    return rows.select("vec_id", "node"), materialize(same, "vector-nodes")


def _links(nodes: DataFrame, d: int, count: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """``(node, m)``: partial sums of the rows that a node links with; ``(a, b)``: links that join all that is linked."""
    spark = nodes.sparkSession
    sample = nodes if count <= FIT_ROWS else nodes.where(F.pmod(F.xxhash64("node"), F.lit(1 << 30)) < int(FIT_ROWS / count * (1 << 30)))
    x = np.array([r["v"] for r in sample.orderBy("node").select("v").collect()], dtype=np.float64).reshape(-1, d)
    x /= np.linalg.norm(x / np.abs(x).max(axis=1, keepdims=True), axis=1, keepdims=True) * np.abs(x).max(axis=1, keepdims=True) if len(x) else 1
    width, number = tables(nodes.groupBy("label").count().agg(F.max("count")).first()[0], threshold)
    model = spark.sparkContext.broadcast(learn_rotation(x, width * number))

    def code(batches):
        mean, projection = model.value
        for batch in small(batches):
            v = _matrix(batch.column(1), d)
            v = v / np.abs(v).max(axis=1, keepdims=True)
            v = v / np.linalg.norm(v, axis=1, keepdims=True)
            short, keys = codes_of(v, mean, projection, width)
            unit = pa.array([u.tobytes() for u in v], pa.binary())
            many = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, number), pa.int32()), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(short), many, unit], names=["node", "label", "n", "code", "keys", "unit"])

    label_type = nodes.schema["label"].dataType.simpleString()
    coded = nodes.select("node", "v", "label", "n").mapInArrow(code, f"node long, label {label_type}, n long, code long, keys array<long>, unit binary")
    coded = materialize(coded.withColumn("spots", F.transform("keys", lambda k, i: F.xxhash64("label", i, k))).drop("label", "keys"), "codes")
    flat = coded.select("node", "code", F.explode("spots").alias("spot"))
    sizes = materialize(flat.groupBy("spot").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "keys")
    hot = sizes.where(F.col("m") > HOT)
    any_hot = hot.limit(1).count() > 0

    usual = flat.join(sizes.where(F.col("m") <= HOT).select("spot"), "spot", "left_semi")
    other = usual.select("spot", F.col("node").alias("b"), F.col("code").alias("code2"))
    pairs = usual.join(other, "spot").where((F.col("node") < F.col("b")) & (F.bit_count(F.col("code").bitwiseXOR(F.col("code2"))) <= MAX_HAMMING))
    pairs = pairs.select(F.col("node").alias("a"), "b").distinct()
    if any_hot:
        at = materialize(flat.select("node", "spot").join(hot, "spot"), "hot-keys")
        lists = materialize(at.groupBy("node").agg(F.sort_array(F.collect_list("spot")).alias("spots")), "hot-lists")
        ends = pairs.join(lists.select(F.col("node").alias("a"), F.col("spots").alias("sa")), "a", "left").join(lists.select(F.col("node").alias("b"), F.col("spots").alias("sb")), "b", "left")
        pairs = ends.where(~F.coalesce(F.arrays_overlap("sa", "sb"), F.lit(False))).select("a", "b")
    one = coded.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("unit").alias("x"))
    two = coded.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("unit").alias("y"))

    def cosine(batches):
        for batch in small(batches):
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.float64).reshape(-1, d) for i in (4, 5))
            yield pa.RecordBatch.from_arrays(batch.columns[:4], names=["a", "b", "na", "nb"]).filter(pa.array(np.einsum("ij,ij->i", x, y) >= threshold))

    close = pairs.join(two, "b").join(one, "a").select("a", "b", "na", "nb", "x", "y").mapInArrow(cosine, "a long, b long, na long, nb long")
    close = materialize(close, "vector-links")
    sums = close.select(F.col("a").alias("node"), F.col("nb").alias("m")).union(close.select("b", "na"))
    joins = close.select("a", "b")
    if any_hot:
        found = materialize(_hot_links(at, lists, coded, d, threshold), "hot-links")
        sums = sums.union(found.where("m IS NOT NULL").select(F.col("a").alias("node"), "m"))
        joins = joins.union(found.where("b IS NOT NULL").select("a", "b"))
    return sums, joins


def _hot_links(at: DataFrame, lists: DataFrame, coded: DataFrame, d: int, threshold: float) -> DataFrame:
    """``(a, m, b)``: sums of links of a node, or links that join, of the keys ``at(spot, node, m)`` that very many vectors share.

    Vectors of a key whose least hot key is the one that most of them have need
    not be compared here with each other; the rest, those apart, are compared
    with all.  Both sides are dealt into blocks, and every pair of blocks is a
    group of its own, so no key meets in one task.
    """
    at = at.join(lists, "node").withColumn("least", F.element_at("spots", 1))
    most = at.groupBy("spot", "least").count().groupBy("spot").agg(F.max_by("least", F.struct("count", "least")).alias("most"))
    at = at.join(most, "spot").withColumn("apart", (F.col("most") == F.col("spot")) | (F.col("least") != F.col("most")))
    at = at.join(at.groupBy("spot").agg(F.sum(F.col("apart").cast("long")).alias("q")).where("q > 0"), "spot")
    rows, columns = F.ceil(F.col("q") / BLOCK), F.ceil(F.col("m") / BLOCK)
    rest = ["spot", "node", "spots", "apart"]
    block = F.abs(F.hash("node").cast("long"))
    sides = at.where("apart").select(*rest, F.lit(0).alias("side"), (block % rows).alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), columns - 1)).alias("j"))
    sides = sides.unionByName(at.select(*rest, F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0).cast("long"), rows - 1)).alias("i"), (block % columns).alias("j")))
    dealt = sides.join(coded.select("node", "n", "unit"), "node").select("spot", "i", "j", "side", "node", "n", "apart", "spots", "unit")

    def run(batches):
        for group in groups(batches, 3):
            spot, side = group.column(0)[0].as_py(), group.column(3).to_numpy()
            x, y = (group.filter(pa.array(side == k)) for k in (0, 1))
            if not x.num_rows or not y.num_rows:
                continue
            node, n, unit, shared = [], [], [], []
            for part in (x, y):
                node.append(part.column(4).to_numpy())
                n.append(part.column(5).to_numpy())
                unit.append(np.frombuffer(b"".join(part.column(8).to_pylist()), np.float64).reshape(-1, d))
                shared.append([{s for s in v if s < spot} for v in part.column(7).to_pylist()])
            apart = np.array(y.column(6).to_pylist())
            hit = unit[0] @ unit[1].T >= threshold
            hit &= node[0][:, None] != node[1][None, :]
            hit &= ~apart[None, :] | (node[0][:, None] < node[1][None, :])
            for s in set().union(*shared[0]) & set().union(*shared[1]):  # compared at a lesser key
                hit &= ~(np.array([s in v for v in shared[0]])[:, None] & np.array([s in v for v in shared[1]])[None, :])
            sums = hit @ n[1], hit.T @ n[0]
            links = _spanning(hit)
            a = np.concatenate((node[0], node[1], node[0][links[0]]))
            k = len(node[0]) + len(node[1])
            m = pa.concat_arrays([pa.array(np.concatenate(sums), pa.int64()), pa.nulls(len(links[0]), pa.int64())])
            b = pa.concat_arrays([pa.nulls(k, pa.int64()), pa.array(node[1][links[1]], pa.int64())])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), m, b], names=["a", "m", "b"])

    return dealt.repartition("spot", "i", "j").sortWithinPartitions("spot", "i", "j").mapInArrow(run, "a long, m long, b long")


def _spanning(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of few of the hits, which join all rows and columns that the hits join."""
    if not hit.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    width = hit.shape[1]
    # The first hit of every row and column; what these leave apart is joined by the first hit between two parts.
    rows, columns = np.flatnonzero(hit.any(axis=1)), np.flatnonzero(hit.any(axis=0))
    chosen = [(rows, hit[rows].argmax(axis=1)), (hit[:, columns].argmax(axis=0), columns)]
    while True:
        r, c = (np.concatenate(x) for x in zip(*chosen))
        left, right = np.arange(hit.shape[0]), np.arange(width) + hit.shape[0]
        while True:
            low = np.minimum(left[r], right[c])
            old = left.copy(), right.copy()
            np.minimum.at(left, r, low)
            np.minimum.at(right, c, low)
            if (left == old[0]).all() and (right == old[1]).all():
                break
        between = hit & (left[:, None] != right[None, :])
        if not between.any():
            return r, c
        at = np.flatnonzero(between.any(axis=1))
        chosen.append((at, between[at].argmax(axis=1)))


def near_duplicate_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row a vector: vec_id, n_links, component_id (least vec_id reachable), kept."""
    rows, nodes = _nodes(vectors)
    found = [_links(nodes.where(F.size("v") == r["d"]), int(r["d"]), int(r["n"]), threshold) for r in nodes.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()]
    placed = nodes.select("node", "n", "least")
    if found:
        sums, joins = found[0]
        for more in found[1:]:
            sums, joins = sums.union(more[0]), joins.union(more[1])
        labels = connected_components(joins).withColumnRenamed("id", "node")
        placed = placed.join(sums.groupBy("node").agg(F.sum("m").alias("m")), "node", "left").join(labels, "node", "left")
        placed = materialize(placed.withColumn("component", F.coalesce("component", "node")), "placed")
        named = placed.groupBy("component").agg(F.min("least").alias("component_id"))
        placed = placed.join(named, "component").select("node", (F.coalesce("m", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    else:
        placed = placed.select("node", F.lit(0).cast("long").alias("n_links"), F.col("least").alias("component_id"))
    out = rows.join(placed, "node", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", F.col("vec_id")).alias("component_id")
    )
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
