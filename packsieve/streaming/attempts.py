"""The last state of a growing attempt log as a stream. An extension: the batch form is ``runs.last_attempts``.

Attempts arrive as rows in append order; the state of a key is the struct with
the largest attempt number, kept by Spark's stateful aggregate. Repeated rows
change nothing; a late row with a smaller number does not either.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("mode", "FAILFAST").option("maxFilesPerTrigger", files_per_trigger).json(path)


def last(attempts: DataFrame, keys: Sequence[str], order: str = "attempt") -> DataFrame:
    """Per key the last attempt and the number of different attempts seen (by their number)."""
    rest = [c for c in attempts.columns if c not in keys]
    return attempts.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_last"), F.max(order).alias("attempts")).select(*keys, "attempts", "_last.*")


def write(states: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes every micro-batch's changed states below ``path``/batch=N: a batch that is repeated replaces its own folder."""

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return states.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(save).trigger(availableNow=True).start()


def current(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The newest state of each key over all batches."""
    rows = spark.read.option("basePath", path).parquet(f"{path}/batch=*")
    rest = [c for c in rows.columns if c not in keys and c != "batch"]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_s")).select(*keys, "_s.*")
