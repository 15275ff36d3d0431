"""Session settings that the operators count on."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import SparkSession


#: Bytes of input for each partition of a shuffle, and for each task that reads files; partitions at most.
PARTITION_BYTES, SPLIT_BYTES, MAX_PARTITIONS = 8 << 20, 16 << 20, 4_000


def configure(spark: SparkSession, folder: str | None = None) -> SparkSession:
    """UTC calendar, last measure wins, adaptive plans with skew handling; tasks that stay as small as they are, however large the tables in ``folder``."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    if folder is not None:
        size_tasks(spark, folder)
    return spark


def size_tasks(spark: SparkSession, folder: str) -> None:
    """As many partitions as the tables' bytes ask for, so that what a task sorts or groups does not grow with them. Adaptive plans put small partitions together again, up to what the number of cores allows."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    size = path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", max(least, min(MAX_PARTITIONS, -(-size // PARTITION_BYTES))))
    for name, most in (("spark.sql.adaptive.advisoryPartitionSizeInBytes", PARTITION_BYTES), ("spark.sql.files.maxPartitionBytes", SPLIT_BYTES)):
        if _bytes(spark, name) > most:
            spark.conf.set(name, most)


def _bytes(spark: SparkSession, name: str) -> int:
    return spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share: that of checkpoints, as ``spark.checkpoint.dir`` or the context names it; on one machine, one of our own."""
    base, at = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.getCheckpointDir()
    if base is None and at is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("on a cluster spark.checkpoint.dir must name a folder that the driver and all executors share")
    base = base or at or f"/tmp/checkpoints/{spark.sparkContext.applicationId}"
    if at is None:
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Lets go of what no DataFrame needs any more: Spark deletes shuffle files once the driver has collected the objects that stand for them."""
    gc.collect()
    spark._jvm.System.gc()
