"""Exact percentiles of a column of any size, by refinement.

A pass counts the values in bins between two bounds; of the bins, only those
that hold a wanted rank are looked at again, with the least and greatest value
that they hold as the new bounds.  When few values are left between the bounds,
they alone are fetched.  A pass is one aggregation with partial sums, and what
reaches the driver is bounded by the number of bins.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

#: Rows up to which the built-in aggregate is used, which keeps every distinct value; bins of a pass; values that are fetched.
DIRECT_ROWS, BINS, FETCHED = 1 << 20, 4096, 1 << 14


def percentiles(rows: DataFrame, column: str, shares: list[float], direct_rows: int = DIRECT_ROWS, bins: int = BINS, fetched: int = FETCHED, first: tuple | None = None) -> list[float] | None:
    """The values at ``shares`` of the order of a column of finite numbers, between two values in proportion; nulls do not count.

    None where there are no values.  ``first`` has their count, the least and the greatest, if they are known.
    """
    values = rows.select(F.col(column).cast("double").alias("v")).where("v IS NOT NULL")
    n, low, high = values.agg(F.count(F.lit(1)), F.min("v"), F.max("v")).head() if first is None else first
    if not n:
        return None
    if n <= direct_rows:
        return list(values.agg(F.percentile("v", F.array(*map(F.lit, shares)))).head()[0])
    places = [(n - 1) * s for s in shares]
    wanted = sorted({r for p in places for r in (math.floor(p), math.ceil(p))})
    # For every rank the bounds of the values that it is among, how many these are, and how many are less.
    state = {r: (low, high, n, 0) for r in wanted}
    for turn in itertools.count():
        open_ = sorted({s for s in state.values() if s[0] < s[1] and s[2] > fetched})
        if not open_:
            break
        found = _histograms(values, open_, bins, turn % 2 == 1)
        for r, s in state.items():
            if s in open_:
                below = s[3]
                for a, b, count in found[open_.index(s)]:
                    if r < below + count:
                        state[r] = (a, b, count, below)
                        break
                    below += count
    left = sorted({s for s in state.values() if s[0] < s[1]})
    few = {}
    if left:
        inside = None
        for a, b, *_ in left:
            inside = F.col("v").between(a, b) if inside is None else inside | F.col("v").between(a, b)
        held = sorted((r["v"], r["n"]) for r in values.where(inside).groupBy("v").agg(F.count(F.lit(1)).alias("n")).collect())
        few = {s: [(v, c) for v, c in held if s[0] <= v <= s[1]] for s in left}
    at = {}
    for r, s in state.items():
        below, at[r] = s[3], s[0]
        for v, c in few.get(s, ()):
            if r < below + c:
                at[r] = v
                break
            below += c
    out = []
    for p in places:
        a, b = math.floor(p), math.ceil(p)
        out.append(at[a] if at[a] == at[b] else (b - p) * at[a] + (p - a) * at[b])
    return out


def _histograms(values: DataFrame, bounds: list[tuple], bins: int, by_size: bool) -> list[list[tuple]]:
    """For every pair of bounds the (least, greatest, count) of its bins, in order.

    Bins are equal parts of the values, or with ``by_size`` of their order of
    magnitude: in turn, so that no distribution keeps all values in one bin.
    """
    which = F.lit(None).cast("int")
    low, high = F.lit(None).cast("double"), F.lit(None).cast("double")
    for i, (a, b, *_) in reversed(list(enumerate(bounds))):
        here = F.col("v").between(a, b)
        which, low, high = (F.when(here, F.lit(x)).otherwise(y) for x, y in ((i, which), (a, low), (b, high)))
    # Half of both bounds first, so that their difference does not overflow; all steps keep the order of the values.
    scaled = (lambda c: F.signum(c) * (F.log2(F.abs(F.col(c))) + 1100)) if by_size else (lambda c: F.col(c) / 2)
    scaled = (lambda c, f=scaled: F.when(F.col(c) == 0, 0.0).otherwise(f(c))) if by_size else scaled
    part = (scaled("v") - scaled("low")) / (scaled("high") - scaled("low"))
    place = F.coalesce(F.floor(part * bins), F.lit(0).cast("long"))
    keyed = values.select("v", which.alias("which"), low.alias("low"), high.alias("high")).where("which IS NOT NULL")
    found = keyed.groupBy("which", F.least(F.greatest(place, F.lit(0)), F.lit(bins - 1)).alias("bin")).agg(F.min("v").alias("a"), F.max("v").alias("b"), F.count(F.lit(1)).alias("n"))
    out: list[list[tuple]] = [[] for _ in bounds]
    for r in found.collect():
        out[r["which"]].append((r["a"], r["b"], r["n"]))
    return [sorted(x) for x in out]


def percentile_row(rows: DataFrame, column: str, shares: list[float], name: str = "p", also: Sequence[Column] = ()) -> DataFrame:
    """One row with the percentiles as an array, and aggregates ``also`` that are taken in the first pass."""
    v = F.col(column).cast("double")
    found = rows.agg(F.count(v), F.min(v), F.max(v), *also)
    n, low, high, *others = found.head()
    kinds = StructType([StructField(name, ArrayType(DoubleType())), *found.schema.fields[3:]])
    return rows.sparkSession.createDataFrame([(percentiles(rows, column, shares, first=(n, low, high)), *others)], kinds)


def by_group(rows: DataFrame, keys: Sequence[str], column: str, share: float) -> DataFrame:
    """``(keys, n, column)``: the rows of every group and a percentile of its values.

    Equal values are counted first, with partial sums; the percentile is of these counts, so that rows are neither sorted nor
    held by group.
    """
    held = rows.groupBy(*keys, column).agg(F.count(F.lit(1)).alias("__n"))
    return held.groupBy(*keys).agg(F.sum("__n").alias("n"), F.percentile(column, F.lit(share), F.col("__n")).alias(column))
