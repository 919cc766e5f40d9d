"""Compression of vectors into codes of integer codebooks (operator 13).

Every vector becomes integers and is cut into equal consecutive parts; each part
position has a codebook of entries.  A round broadcasts the codebooks (their
size is fixed by the parameters and the dimension), takes the distances of an
Arrow batch by the expansion of the norm, ``|x|^2 - 2 x c + |c|^2``, with exact
integer matrix products, and takes the first least one.  A task sums the parts
of every entry itself, and a grouped shuffle merges these sums, so that a common
vector or label costs no more than others.

Integers are 64 bits where the distances of a batch surely fit, and of any
length elsewhere.

Defined cases: vectors that are null, or hold null or non-finite components, are
dropped, as are those without components and those whose length is not that of
the least vec_id's vector, which sets the length of all; a length that parts do
not divide is filled up with zeros.  Ties of vec_id fall to the lesser vector,
null ids come last, repeated rows get the same code.  With fewer rows than
entries the codebooks are shorter.  Components beyond 2^62 after scaling count
as 2^62, errors beyond a long as the largest long.  Null labels are one label.
An empty table has no rows.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfloor.llm.common import materialize

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Bound of a scaled component.
MOST = 1 << 62
MAX_LONG = (1 << 63) - 1
#: Rows of labels that are broadcast at most: 16 bytes each, and the label.
MAX_BROADCAST_LABELS = 200_000


def integer_vectors(vectors: DataFrame, scale: int, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """``(id, v array<long>, label)`` of the vectors that are kept."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).alias("id"), v.alias("v"), F.col(label_col).alias("label"))
    ok = (F.size("v") > 0) & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    whole = F.transform("v", lambda c: F.floor(F.greatest(F.lit(-float(MOST)), F.least(F.lit(float(MOST)), c * float(scale)))))
    return rows.where(F.coalesce(ok, F.lit(False))).select("id", whole.alias("v"), "label")


def parts_of(x: np.ndarray, parts: int) -> np.ndarray:
    """Rows of integers as (parts, rows, width), filled up with zeros."""
    width = -(-x.shape[1] // parts)
    full = np.zeros((len(x), width * parts), x.dtype)
    full[:, : x.shape[1]] = x
    return full.reshape(len(x), parts, width).transpose(1, 0, 2)


def nearest(x: np.ndarray, codebook: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first nearest entry, squared distance) of every row of ``x``, exactly."""
    largest = max(int(abs(x).max(initial=0)), int(abs(codebook).max(initial=0)))
    if 4 * max(1, x.shape[1]) * largest * largest >= 1 << 62:
        x, codebook = x.astype(object), codebook.astype(object)
    else:
        x, codebook = x.astype(np.int64), codebook.astype(np.int64)
    part = (codebook * codebook).sum(axis=1)[None, :] - 2 * (x @ codebook.T)
    at = part.argmin(axis=1)
    return at, (x * x).sum(axis=1) + part[np.arange(len(x)), at]


def _matrices(batch, at: int, dims: int, rows: int = 2048):
    """The vectors of a batch as integer matrices of few rows, so that the distances of a slice stay small."""
    for begin in range(0, batch.num_rows, rows):
        piece = batch.slice(begin, rows)
        yield piece, piece.column(at).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _sums(rows: DataFrame, dims: int, books, parts: int) -> list:
    """(part, entry, position, sum, count) of the parts assigned to every entry, at most one a component of the codebooks."""

    def run(batches):
        total = count = None
        for batch in batches:
            for _, x in _matrices(batch, 0, dims):
                cut = parts_of(x, parts)
                if total is None:
                    entries = len(books.value[0])
                    total, count = np.zeros((parts, entries, cut.shape[2]), object), np.zeros((parts, entries), np.int64)
                small = int(abs(cut).max(initial=0)) < 1 << 48  # of a slice the sums fit in 64 bits
                for p in range(parts):
                    at, _ = nearest(cut[p], books.value[p])
                    sums = np.zeros(total[p].shape, np.int64 if small else object)
                    np.add.at(sums, at, cut[p] if small else cut[p].astype(object))
                    total[p] += sums
                    count[p] += np.bincount(at, minlength=len(count[p]))
        if total is not None:
            p, e = np.nonzero(count)
            n, width = len(p), total.shape[2]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(p, width), pa.int32()),
                    pa.array(np.repeat(e, width), pa.int32()),
                    pa.array(np.tile(np.arange(width), n), pa.int32()),
                    pa.array([str(s) for s in total[p, e].ravel()], pa.string()),
                    pa.array(np.repeat(count[p, e], width), pa.int64()),
                ],
                names=["part", "entry", "position", "total", "n"],
            )

    found = rows.select("v").mapInArrow(run, "part int, entry int, position int, total string, n long")
    merged = found.groupBy("part", "entry", "position").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
    return merged.collect()


def learn_codebooks(rows: DataFrame, dims: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (parts, entries, width) of ``rows(id, v, label)``, from the vectors of the least ids."""
    first = rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    books = parts_of(np.array([r["v"] for r in first], dtype=np.int64), parts).copy()
    for _ in range(rounds):
        shared = rows.sparkSession.sparkContext.broadcast(books)
        new = books.copy()
        for r in _sums(rows, dims, shared, parts):
            new[r["part"], r["entry"], r["position"]] = int(r["total"]) // r["n"]
        shared.unpersist()
        books = new
    return books


def codebooks_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> tuple[DataFrame, np.ndarray]:
    """``(id, label, codes array<int>, error decimal)`` of every kept vector, and the codebooks (parts, entries, width)."""
    if not 0 < entries <= 256:
        raise ValueError("codes have two hexadecimal digits: 1 to 256 entries")
    kept = materialize(integer_vectors(vectors, scale, id_col, vector_col, label_col), "integer-vectors")
    schema = f"id {kept.schema['id'].dataType.simpleString()}, label {kept.schema['label'].dataType.simpleString()}, codes array<int>, error string"
    least = kept.orderBy(F.col("id").asc_nulls_last(), "v").select(F.size("v")).head()
    if least is None:
        return kept.sparkSession.createDataFrame([], schema).withColumn("error", F.col("error").cast("decimal(38,0)")), np.zeros((parts, 0, 0), np.int64)
    dims = least[0]
    kept = kept.where(F.size("v") == dims)
    books = learn_codebooks(kept, dims, parts, entries, rounds)
    shared = kept.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        for batch in batches:
            for piece, x in _matrices(batch, 2, dims):
                cut = parts_of(x, parts)
                found = [nearest(cut[p], shared.value[p]) for p in range(parts)]
                codes = np.stack([at for at, _ in found], axis=1).astype(np.int32)
                error = sum(d.astype(object) for _, d in found)
                column = pa.ListArray.from_arrays(pa.array(np.arange(0, codes.size + 1, parts, dtype=np.int32)), pa.array(codes.ravel()))
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), column, pa.array(map(str, error), pa.string())], names=["id", "label", "codes", "error"])

    coded = kept.select("id", "label", "v").mapInArrow(run, schema)
    return coded.withColumn("error", F.col("error").cast("decimal(38,0)")), books


def code_digest(vectors: DataFrame, **options) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every kept row of ``embeddings``."""
    coded, books = compress(vectors, **options)
    coded = materialize(coded, "vector-codes")
    long = lambda c: F.least(c, F.lit(MAX_LONG).cast("decimal(38,0)")).cast("long")
    labels = materialize(coded.groupBy("label").agg(F.sum("error").alias("label_total")).withColumnRenamed("label", "of"), "label-errors")
    if labels.count() <= MAX_BROADCAST_LABELS:
        labels = F.broadcast(labels)
    code = F.array_join(F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    joined = coded.join(labels, F.col("label").eqNullSafe(F.col("of")))
    return joined.select(
        F.col("id").alias("vec_id"), code.alias("code"), long(F.col("error")).alias("error"), long(F.col("label_total")).alias("label_error"), F.lit(codebooks_digest(books)).alias("codebooks_sha256")
    )
