"""Intermediate tables in the folder that driver and executors share.

A written table cuts lineage: a lost executor costs the tasks that it ran, not
the stages before the table. The folder is the one in ``spark.checkpoint.dir``;
only where a session has none and runs in one process is a temporary one set. On a
cluster, which could not share it, a session without the setting is refused.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster, without a trailing slash."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="packsieve-")
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir()
    if "://" not in folder and not folder.startswith("file:"):
        folder = f"file://{folder}"
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def table(df: DataFrame, name: str) -> DataFrame:
    """``df``, written once to the shared folder and read from there."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written.scratch_path = path
    return written


#: Rows that go to a Python worker at a time, where rows hold whole texts: workers and the JVM keep the memory of the largest batch.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches for this session; a smaller setting of the user's stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def dealt(df: DataFrame) -> DataFrame:
    """A scanned table dealt out anew if it has fewer partitions than there are cores: small files often come as one task. Large tables stay where they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < cores else df


def whole(df: DataFrame) -> Column:
    """All columns as one struct ``_doc``: extra columns can't clash with an operator's own; ``_doc.*`` gives them back."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_doc")


def drop(df: DataFrame) -> None:
    """Deletes a table made by ``table`` that nothing reads any more."""
    remove(df.sparkSession, df.scratch_path)


def remove(spark: SparkSession, path: str) -> None:
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(fs_path, True)
