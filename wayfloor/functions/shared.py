"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.

    Where the session names none, a session on one machine (``local``) gets a
    temporary one; a cluster, whose machines share no such folder, gets an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="wayfloor-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Whether Spark deletes the shuffle files of a query when it ends, rather than when the driver happens to collect its plan.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def saved(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written to the shared folder and read back: cuts lineage, survives lost executors.

    The shuffle files of the write go with its end, since the table holds what they led to.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/wayfloor-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what ``saved`` wrote for these tables; nothing that is still to be computed may read them."""
    for table in tables:
        path = getattr(table, "__dict__", {}).get("_saved_at")
        if path:
            jvm, conf = table.sparkSession._jvm, table.sparkSession._jsparkSession.sessionState().newHadoopConf()
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)
