"""Near-duplicate documents by DartMinHash signatures (operator 2).

A document is a weighted set: its shingles of five words, each with the binary
length of its number of places as weight (1 for one, 2 for two or three, 3 for
four to seven), so repeats count, but a page of one line outweighs nothing.
Every element throws darts at the plane of weights and ranks: in each dyadic
region of weights the darts of an element arrive as a Poisson process whose
numbers come from a hash of element, region and arrival.  A dart counts if it
lands below the element's weight.  Each dart also has a coordinate; a
coordinate keeps its earliest dart, whose name is the signature's value there.
About k ln k + 2k darts fill k coordinates whatever the size of the set, so a
signature costs little more than reading the set.  Two signatures agree at a
coordinate with the probability of the weighted Jaccard similarity.  The sets
of many documents throw their darts in the same whole-array operations.

Signatures are banded, documents that collide are verified by the weighted
Jaccard similarity of their whole sets, and classes are connected components.  Documents with the same set
are one node from the start, so copies are never paired.

Defined cases: null, empty and blank texts have no shingles and are classes of
their own (kept); text without a word is one shingle; fewer than five words are
one shingle; repeated rows share a class; a row without a doc_id takes the
class of its text.  Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfloor.llm.common import materialize, row_key, small
from wayfloor.llm.lsh import bands_for, link_classes
from wayfloor.llm.shingles import expanded, mix, set_node, weighted_shingles

THRESHOLD, ROWS, MISS = 0.8, 5, 1e-5
BANDS = bands_for(THRESHOLD, ROWS, MISS)
#: Node ids up to this number are broadcast to find their texts; more are joined with a shuffle.
MAX_BROADCAST_IDS = 1_000_000
#: Elements of the sets that throw their darts together, about.
DART_ELEMENTS = 200_000


def _darts(elements: np.ndarray, weights: np.ndarray, owners: np.ndarray, until: np.ndarray, low: float, width: float, region: int):
    """(rank, name, owner) of the darts that one region of weights holds up to a rank, ``until`` by owner."""
    seed = mix(elements + np.uint64(0x9E3779B97F4A7C15 * (region + 1) % (1 << 64)))
    rank = np.zeros(len(seed))
    out = []
    arrival = 0
    whole = not low and width == 1 and not (weights < 1).any()
    while len(seed):
        step = max(1, min(64, 4096 // len(seed)))  # few elements throw many darts each
        numbers = np.arange(arrival + 1, arrival + step + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)
        name = mix(seed[:, None] ^ mix(numbers)[None, :])
        gap = -np.log1p(-((name >> np.uint64(11)).astype(np.float64) * 2.0**-53)) / width
        at = rank[:, None] + (np.cumsum(gap, axis=1) if step > 1 else gap)
        inside = at <= until[owners][:, None]
        lands = inside
        if not whole:
            height = low + width * ((mix(name + np.uint64(1)) >> np.uint64(11)).astype(np.float64) * 2.0**-53)
            lands = inside & (height < weights[:, None])
        out.append((at[lands], name[lands], np.broadcast_to(owners[:, None], lands.shape)[lands]))
        going = inside[:, -1]
        seed, rank, weights, owners = seed[going], at[going, -1], weights[going], owners[going]
        arrival += step
    return tuple(np.concatenate(c) for c in zip(*out))


def dart_signatures(sets: list[tuple[np.ndarray, np.ndarray]], k: int) -> np.ndarray:
    """The names of the earliest darts at k coordinates, a row for every (elements, positive weights); 0 for an empty set."""
    out = np.zeros((len(sets), k), np.uint64)
    size = np.array([len(e) for e, _ in sets], np.int64)
    if not size.sum():
        return out
    elements, weights = (np.concatenate([s[i] for s in sets]) for i in (0, 1))
    weights, owners = weights.astype(np.float64), np.repeat(np.arange(len(sets)), size)
    until = (k * np.log(k) + 2 * k) / np.maximum(np.bincount(owners, weights, minlength=len(sets)), 1e-300)
    todo = size > 0
    while todo.any():
        best, names = np.full(len(sets) * k, np.inf), np.zeros(len(sets) * k, np.uint64)
        low, width, region, found = 0.0, 1.0, 0, []
        while low < weights.max():
            over = weights > low
            found.append(_darts(elements[over], weights[over], owners[over], until, low, width, region))
            low, width, region = low + width, low + width, region + 1
        rank, name, owner = (np.concatenate(c) for c in zip(*found))
        spot = ((mix(name + np.uint64(2)) >> np.uint64(32)) * np.uint64(k) >> np.uint64(32)).astype(np.int64) + owner * k
        np.minimum.at(best, spot, rank)
        first = rank == best[spot]
        names[spot[first]] = name[first]
        filled = np.isfinite(best.reshape(-1, k)).all(axis=1) & todo
        out[filled] = names.reshape(-1, k)[filled]
        todo &= ~filled
        again = todo[owners]
        elements, weights, owners = elements[again], weights[again], owners[again]
        until = until * 2  # the earliest darts so far stay the earliest
    return out


def dart_signature(elements: np.ndarray, k: int, weights: np.ndarray | None = None) -> np.ndarray:
    """The signature of one set; weights are 1 if not given."""
    return dart_signatures([(elements, np.ones(len(elements)) if weights is None else weights)], k)[0]


def band_values(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One signed 64-bit value a band, of signatures in rows."""
    s = signatures[:, : bands * rows].reshape(-1, bands, rows)
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), s.shape[:2])
    for i in range(rows):
        out = mix(out * np.uint64(0xD1342543DE82EF95) + s[:, :, i])
    return out.view(np.int64)


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``(id, key, node, bands)``: node names the set of shingles, null if there is none; key names the row."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in small(batches):
            sets = weighted_shingles(batch.column(2).cast(pa.binary()).to_pylist())
            none = np.array([not len(e) for e, _ in sets], bool)
            nodes = pa.array([set_node(expanded(*s)) for s in sets], pa.int64(), mask=none)
            cuts = [0, *(np.flatnonzero(np.diff(np.cumsum([len(e) for e, _ in sets]) // DART_ELEMENTS)) + 1).tolist(), len(sets)]
            values = np.concatenate([band_values(dart_signatures(sets[a:b], bands * rows), bands, rows) for a, b in zip(cuts, cuts[1:]) if b > a])
            many = pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, bands), pa.int32()), pa.array(values.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), nodes, many], names=[id_col, "key", "node", "bands"])

    rows_in = docs.select(F.col(id_col), row_key(id_col, text_col).alias("key"), F.col(text_col).cast("string").alias("__text"))
    return rows_in.mapInArrow(run, f"`{id_col}` {id_type}, key long, node long, bands array<long>")


def _sets(rows: DataFrame) -> DataFrame:
    """``(node, __text)`` -> ``(node, shingles)``."""

    def run(batches):
        for batch in small(batches):
            sets = [expanded(*s).tobytes() for s in weighted_shingles(batch.column(1).cast(pa.binary()).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["node", "shingles"])

    return rows.mapInArrow(run, "node long, shingles binary")


def _classes(docs: DataFrame, id_col: str, text_col: str, threshold: float) -> DataFrame:
    """``(id, key, component_id, kept, first)`` for every row; ``first`` holds for one text of a class, the first by id."""
    signed = materialize(signatures(docs, id_col, text_col), "signatures")
    place = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col("key"))
    nodes = materialize(
        signed.where("node IS NOT NULL").groupBy("node").agg(F.first("bands").alias("bands"), F.min("key").alias("key"), F.min(id_col).alias("least"), F.min(place).alias("place")), "nodes"
    )

    def fetch(ids: DataFrame) -> DataFrame:
        wanted = nodes.join(ids, "node", "left_semi").select("node", "key")
        if ids.count() <= MAX_BROADCAST_IDS:
            wanted = F.broadcast(wanted)
        texts = docs.select(row_key(id_col, text_col).alias("key"), F.col(text_col).cast("string").alias("__text")).join(wanted, "key")
        return _sets(texts.select("node", "__text")).dropDuplicates(["node"])

    labels = link_classes(nodes.select("node", "bands"), fetch, threshold)
    placed = nodes.select("node", "least", "place").join(labels.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    placed = materialize(placed, "placed")
    named = placed.join(placed.groupBy("component").agg(F.min("least").alias("component_id"), F.min("place").alias("first")), "component").select("node", "component_id", F.col("first.key").alias("first"))
    return signed.join(named, "node", "left").select(
        id_col,
        "key",
        F.when(F.col("node").isNull(), F.col(id_col)).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce(F.col("node").isNull() | (F.col(id_col) == F.col("component_id")), F.col("component_id").isNull()).alias("kept"),
        (F.col("node").isNull() | (F.col("key") == F.col("first"))).alias("first"),
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row a document: id, ``component_id`` (the least id of its class) and ``kept`` (it has that id)."""
    return _classes(docs, id_col, text_col, threshold).drop("key", "first")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one document of each class, the first by id; all columns stay.  Of rows that repeat id and text one stays, and of rows of one id with texts of one class, too."""
    found = materialize(_classes(docs, id_col, text_col, threshold), "classes")
    gone = found.where(~F.col("first")).select(F.col("key").alias("__wf_key")).distinct()
    gone = F.broadcast(gone) if gone.count() <= MAX_BROADCAST_IDS else gone
    keyed = docs.withColumn("__wf_key", row_key(id_col, text_col))
    rest = keyed.join(gone, "__wf_key", "left_anti")
    if found.where("first").groupBy("key").count().where(F.col("count") > 1).limit(1).count():
        rest = rest.dropDuplicates(["__wf_key"])
    return rest.select(*docs.columns)
