"""Key-frame replay and running occupancy as structured streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfloor.functions.shared import saved
from wayfloor.operators.points import cell, finite, z_band


def keyframes(spark: SparkSession, folder: str, schema: str = "frame long, x double, y double, z double") -> DataFrame:
    """Frames as they arrive in a folder of Parquet files, one file a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def cleaned(points: DataFrame, z_min: float = 0.05, z_max: float = 0.80, voxel: float = 0.05) -> DataFrame:
    """Finite points of the band with their voxel; voxels are counted by frame in the stream's state."""
    kept = z_band(finite(points), z_min, z_max)
    return kept.select("frame", *(cell(F.col(c), voxel).alias(f"v{c}") for c in "xyz"), "x", "y", "z")


def frame_voxels(points: DataFrame) -> DataFrame:
    """Mean point of every voxel of every frame."""
    return points.groupBy("frame", "vx", "vy", "vz").agg(F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(c) for c in "xyz"))


def occupancy_counts(points: DataFrame, resolution: float = 0.05) -> DataFrame:
    """Running number of points of every map cell over all frames, for update or complete mode."""
    return points.groupBy(cell(F.col("y"), resolution).alias("gy"), cell(F.col("x"), resolution).alias("gx")).agg(F.count(F.lit(1)).alias("n"))


def event_windows(events: DataFrame, length: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Events by type and tumbling window, with a watermark on ``ts``."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", length), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def numbered(rows: DataFrame, order: str, name: str = "idx", parts: int = 64) -> DataFrame:
    """Adds the place of every row in the order of a column, from 1: ranges are sorted apart, after the sizes of those before."""
    from pyspark.sql import Window

    at = saved(rows.repartitionByRange(parts, order).sortWithinPartitions(order).withColumn("__p", F.spark_partition_id()))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    sizes = at.groupBy("__p").agg(F.count(F.lit(1)).alias("__n")).withColumn("__b", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("__p").orderBy(order))
    return at.withColumn("__i", inside).join(F.broadcast(sizes.select("__p", "__b")), "__p").withColumn(name, F.col("__i") + F.col("__b")).drop("__p", "__i", "__b")


def paired_poses(frames: DataFrame, poses: DataFrame) -> DataFrame:
    """The n-th frame by number with the n-th pose by time; what has no partner goes."""
    a = numbered(frames.select("frame").distinct(), "frame")
    return a.join(numbered(poses, "t"), "idx").drop("idx")


def with_poses(points: DataFrame, poses: DataFrame) -> DataFrame:
    """A stream of frames with the pose of their number, ``poses(frame, tx, ty, tz, qx, qy, qz, qw)``, a table; coordinates stay the sensor's."""
    return points.join(poses, "frame")


def published(stream: DataFrame, folder: str, checkpoint: str, seconds: float | None = None):
    """Write every batch once to a folder of its number, at most every so many seconds, or all that is there and stop.

    A batch that is run again after a failure replaces what it wrote, so no
    result of an earlier attempt stays.
    """

    def sink(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/batch={batch}")

    writer = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=f"{seconds} seconds") if seconds else writer.trigger(availableNow=True)
    return writer.start()
