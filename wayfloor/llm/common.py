"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import sys
import types

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfloor.functions.shared import discard, saved
from wayfloor.operators.components import spread_labels


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    return saved(df, name)


def shared_model(spark: SparkSession, model):
    """A function that gives tasks the model: its data are broadcast as plain arrays and dicts, its class travels with the task."""
    data, kind = spark.sparkContext.broadcast(dict(vars(model))), type(model)

    def there():
        found = kind.__new__(kind)
        found.__dict__.update(data.value)
        return found

    return there


def process_cache() -> dict:
    """A cache that lasts as long as the worker process: functions are pickled by value, so module globals would not."""
    return sys.modules.setdefault("_wayfloor_process_cache", types.ModuleType("_wayfloor_process_cache")).__dict__


def small(batches, rows: int = 512):
    """Arrow batches in slices, so that a worker holds the Python objects of few rows at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def groups(batches, keys: int):
    """One Arrow table for every run of rows that agree in the first ``keys`` columns, of batches sorted by them."""
    held, last = [], None
    for batch in batches:
        columns = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]) if batch.num_rows else np.zeros((0, keys))
        cuts = [0, *(np.flatnonzero((columns[1:] != columns[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            key = tuple(columns[a].tolist())
            if held and key != last:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def row_key(id_col: str, text_col: str):
    """A 64-bit key of a document row; rows that repeat in id and text share it, nulls have a value of their own."""
    return F.xxhash64(
        F.coalesce(F.col(id_col).cast("string"), F.lit("\x00null")),
        F.coalesce(F.col(text_col).cast("string"), F.lit("\x00null")),
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph: ``edges(a, b)`` longs -> ``(id, component)``, component the least id."""
    both = materialize(
        edges.select(F.col("a").alias("s"), F.col("b").alias("t")).union(edges.select(F.col("b").alias("s"), F.col("a").alias("t"))).where("s <> t").distinct(), "edges"
    )
    labels = spread_labels(both.select(F.col("s").alias("id")).distinct(), both)
    discard(both)
    return labels.withColumnRenamed("label", "component")
