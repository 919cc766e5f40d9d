"""Intermediate tables."""

import subprocess
import sys

RUN = """
import sys, time
sys.path.insert(0, {repo!r})
from pathlib import Path
from pyspark.sql import SparkSession, functions as F
from wayfloor.functions.shared import saved
spark = (
    SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4")
    .config("spark.local.dir", {tmp!r}).config("spark.checkpoint.dir", "file://" + {tmp!r} + "/tables").getOrCreate()
)
left = lambda: [p.name for p in Path({tmp!r}).rglob("shuffle_*")]
spark.conf.set("spark.sql.adaptive.enabled", "false")
kept = saved(spark.range(20000).groupBy((F.col("id") % 7919).alias("k")).agg(F.count(F.lit(1)).alias("n")))
twice = saved(kept.join(kept.select("k", F.col("n").alias("m")).repartition(3, "m"), "k"))
assert kept.count() == twice.count() == 7919
before = set(left())
saved(kept.repartition(3, "n"))
end = time.time() + 20
while set(left()) - before and time.time() < end:
    time.sleep(0.2)
print("LEFT", len(set(left()) - before))
"""


def test_shuffle_files_of_a_saved_table_go_with_the_write(tmp_path):
    from pathlib import Path

    code = RUN.format(repo=str(Path(__file__).parents[1]), tmp=str(tmp_path))
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=240)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "LEFT 0" in done.stdout
