"""Positions within groups of which one may hold a third of all rows.

A window over the group alone would sort that group in one task. Rows go to
buckets by a hash of their order key instead; a group's buckets are summed, the
sums are accumulated over the (few) buckets, and rows are numbered inside one
bucket of one group. The order is that of (bucket, order key): any fixed order
serves the callers, and this one is the same in every run.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucket_count(rows: int, rows_per_bucket: int = 1000) -> int:
    """Buckets that keep a bucket of even the largest group near ``rows_per_bucket`` rows, or near the root of all rows, so that neither buckets nor rows in one grow beyond it."""
    return max(32, -(-rows // max(rows_per_bucket, math.isqrt(rows))))


def with_offsets(df: DataFrame, group: list[str], order: list[str], value: Column, buckets: int, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the rows of the group before this one.

    Nulls in ``group`` form a group of their own. Rows equal in ``order`` are
    interchangeable. Column names starting with ``_o_`` are taken.
    """
    keys = [f"_o_{i}" for i in range(len(group))]
    rows = df.select(
        "*",
        # a struct is never null, so null groups join like any other
        *[F.struct(F.col(g).alias("v")).alias(k) for g, k in zip(group, keys, strict=True)],
        F.pmod(F.xxhash64(*order), F.lit(buckets)).alias("_o_bucket"),
        value.cast("long").alias("_o_value"),
    )
    cell = [*keys, "_o_bucket"]
    before = Window.partitionBy(*keys).orderBy("_o_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = (
        rows.groupBy(*cell).agg(F.sum("_o_value").alias("_o_sum"))
        .select(*cell, F.coalesce(F.sum("_o_sum").over(before), F.lit(0)).alias("_o_base"))
    )
    inside = Window.partitionBy(*cell).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_o_local", F.coalesce(F.sum("_o_value").over(inside), F.lit(0)))
    return (
        rows.join(base, cell)
        .withColumn(name, F.col("_o_base") + F.col("_o_local"))
        .drop(*cell, "_o_value", "_o_local", "_o_base")
    )
