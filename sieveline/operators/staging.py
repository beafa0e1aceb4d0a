"""Tables that a plan reads several times, and joins whose small side is measured first."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side is broadcast.
BROADCAST_ROWS = 500_000
#: Rows of one part of a table that is dealt out by a key.
PART_ROWS = 500_000


def staged(df: DataFrame) -> DataFrame:
    """df computed once: written to the checkpoint folder if the session has one, else kept by the executors, which can compute lost parts anew."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            return df.persist()
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def small_or_shuffled(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df as the side of a join: broadcast if it has no more rows than given, which is counted; else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def spread(df: DataFrame) -> DataFrame:
    """df in as many partitions as there are cores, if it has fewer; large tables have more and stay where they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def dealt(df: DataFrame, by: str) -> DataFrame:
    """df dealt out by a key in parts that grow with its rows, which are counted; there are at least as many as cores. Groupings and windows by the key stay within them.

    Beyond the most parts that a shuffle writes without holding rows back, parts become larger instead of more.
    """
    context = df.sparkSession.sparkContext
    most = int(context.getConf().get("spark.shuffle.sort.bypassMergeThreshold", "200"))
    return df.repartition(max(context.defaultParallelism, min(most, -(-df.count() // PART_ROWS))), by)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever file system its scheme names."""
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark._jsc.hadoopConfiguration()).exists(own)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path below spark.checkpoint.dir; without that setting one of this machine, in local mode alone."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="sieveline-")
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"
