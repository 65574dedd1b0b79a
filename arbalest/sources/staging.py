"""Intermediate tables in the shared folder: lineage ends there, so that a lost executor costs no recomputation before them."""

from __future__ import annotations

import contextlib
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of an Arrow batch of texts; Spark's own limit is 64 MB, of which a task holds several.
BATCH_BYTES = 4 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where nothing is set, a local session gets a temporary one; on a cluster that is an
    error, since executors would write to folders of their own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="arbalest-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def located(spark: SparkSession, path: str):
    """Hadoop's path and file system of a path."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def fresh_path(spark: SparkSession, name: str = "stage") -> str:
    """A new path in the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    at, system = located(spark, path)
    system.deleteOnExit(at)
    return path


def stage(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: for results that several later steps read."""
    path = fresh_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def stage_and_free(df: DataFrame) -> DataFrame:
    """``stage``; then the driver collects its garbage, so that the shuffle files behind the table can go. Spark removes them when the plans
    that made them are collected, which a driver with memory to spare puts off."""
    out = stage(df)
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return out


def in_small_batches(df: DataFrame) -> DataFrame:
    """``df``, whose session from now on hands texts to Python in batches of ``BATCH_BYTES`` at most (a smaller limit stays).
    Results do not depend on it; memory beside the heap does. A lazy plan reads the setting when it runs, so it is not put back."""
    spark, name = df.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))  # "64m" and the like
    if not 0 < held <= BATCH_BYTES:
        spark.conf.set(name, BATCH_BYTES)
    return df


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table that no plan reads any more."""
    with contextlib.suppress(Exception):  # it goes at the end all the same
        at, system = located(spark, path)
        system.delete(at, True)


def numbered(sorted_rows: DataFrame) -> DataFrame:
    """Rows of a frame that is sorted across its partitions, with ``row_no`` from 0.

    Each row's partition and its place there are written with the row, so that offsets and rows cannot part when a task is run again.
    """
    at = sorted_rows.withColumn("_at", F.monotonically_increasing_id())
    at = stage(at.withColumns({"_part": F.shiftright("_at", 33), "_row": F.col("_at").bitwiseAND((1 << 33) - 1)}).drop("_at"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    parts = at.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    return at.join(parts, "_part").withColumn("row_no", F.col("_first") + F.col("_row")).drop("_part", "_row", "_first")
