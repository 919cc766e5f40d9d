"""Views derived from the driver's tables: a synthetic 10 m by 6 m room seen by a scanner.

The text of ``SCAN`` runs unchanged in Spark and in DuckDB; doubles are written
with exponents so that neither reads them as decimals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCAN = """
SELECT point_id, x, y,
       CASE WHEN k <= 5 THEN (CASE WHEN x >= 6e0 AND x < 8e0 THEN (x - 6e0) * 2e-1 WHEN x >= 8e0 THEN 4e-1 ELSE 0e0 END) + jz
            WHEN k <= 7 THEN h * 1e-2
            WHEN k = 8  THEN CAST(h % 90 AS DOUBLE) * 1e-2
            ELSE 3e0 + jz END AS z,
       CASE WHEN k <= 5 THEN 0 WHEN k <= 7 THEN 1
            WHEN k = 8 THEN (CASE WHEN x < 3e0 THEN 13 WHEN x < 6e0 THEN 14 ELSE 9 END)
            ELSE 0 END AS label
FROM (
  SELECT point_id, k, h, jz,
    CASE WHEN k <= 5 OR k = 9 THEN CAST(u AS DOUBLE) * 1e-2
         WHEN k = 6 THEN CAST(u AS DOUBLE) * 1e-2
         WHEN k = 7 THEN (CASE WHEN v % 2 = 0 THEN 2e-2 ELSE 998e-2 END)
         ELSE 2e0 + CAST(u % 3 AS DOUBLE) * 2e0 + CAST(u % 50 AS DOUBLE) * 1e-2 END AS x,
    CASE WHEN k <= 5 OR k = 9 THEN CAST(v AS DOUBLE) * 1e-2
         WHEN k = 6 THEN (CASE WHEN u % 2 = 0 THEN 2e-2 ELSE 598e-2 END)
         WHEN k = 7 THEN CAST(v AS DOUBLE) * 1e-2
         ELSE 2e0 + CAST(v % 60 AS DOUBLE) * 1e-2 END AS y
  FROM (
    SELECT l_orderkey * 8 + l_linenumber AS point_id,
           (l_orderkey * 7 + l_linenumber * 3) % 10 AS k,
           (l_partkey * 37 + l_orderkey * 11 + l_linenumber * 101) % 1000 AS u,
           (l_suppkey * 53 + l_orderkey * 29 + l_linenumber * 17) % 600 AS v,
           (l_orderkey * 13 + l_partkey) % 250 AS h,
           (l_quantity - 25e0) * 1e-4 AS jz
    FROM {lineitem}) a ) b
"""


def scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(point_id, x, y, z, label)``; point_id is not unique.

    The columns are generated from one struct a point.  A filter on a plain projection is pushed below it with the text
    of every nested CASE in place of each column; that code is too long to be compiled and runs tens of times slower.
    """
    points = spark.sql(SCAN, lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))
    return points.select(F.inline(F.array(F.struct(*points.columns))))


#: The same view for SQL counterparts.
SCAN_CTE = "scan AS (" + SCAN.replace("{lineitem}", "lineitem") + ")"
