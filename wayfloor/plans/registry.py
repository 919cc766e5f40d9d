"""Registration of queries with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfloor.functions.fixtures import SCAN_CTE

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, recursive: bool = False):
    """Register ``f(spark, sf_dir)``; ``sql`` continues after the CTE of the scan."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = f"WITH {'RECURSIVE ' if recursive else ''}{SCAN_CTE}{sql}"
        return f

    return add


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles to a fixed number of places, as both engines agree on; no negative zero."""
    kinds = dict(df.dtypes)
    return df.select(*((F.round(c, places) + F.lit(0.0)).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in df.columns))
