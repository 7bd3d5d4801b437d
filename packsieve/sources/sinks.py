"""Canonical JSON, atomic replacement, checks against what is committed, reports (K1-K6)."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packsieve.operators.matching import replay


def canonical(col: Column, kind: T.DataType) -> Column:
    """A column with the fields of its structs in order of their names, at every depth."""
    if isinstance(kind, T.StructType):
        inner = [canonical(col[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)]
        return F.when(col.isNotNull(), F.struct(*inner))
    if isinstance(kind, T.ArrayType):
        return F.transform(col, lambda x: canonical(x, kind.elementType))
    return col


def canonical_json(df: DataFrame) -> Column:
    """K1: a row as JSON with sorted keys, no white space, nulls kept."""
    fields = [canonical(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in sorted(df.schema.fields, key=lambda f: f.name)]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def write_jsonl(df: DataFrame, path: str, order: Sequence[str], compression: str = "none", files: int | None = None) -> None:
    """K1, K6: one object a line, in order. ``files=1`` gives the one file that small outputs are; large ones keep their partitions."""
    rows = df.orderBy(*order).select(canonical_json(df).alias("value"))
    (rows.coalesce(files) if files else rows).write.mode("overwrite").option("compression", compression).text(path)


def replace(spark: SparkSession, write, path: str) -> None:
    """K2: ``write(staging)`` beside the target, then one rename; readers see the old tree or the new."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    staged, target, old = fs_path(f"{path}.staged-{uuid.uuid4().hex}"), fs_path(path), fs_path(f"{path}.old-{uuid.uuid4().hex}")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        write(staged.toString())
        if fs.exists(target) and not fs.rename(target, old):
            raise OSError(f"{path} can't be moved away")
        if not fs.rename(staged, target):
            fs.rename(old, target)
            raise OSError(f"{path} can't be replaced")
    finally:
        fs.delete(staged, True)
        fs.delete(old, True)


def check(committed: DataFrame, rebuilt: DataFrame, keys: Sequence[str], volatile: Sequence[str] = ("created_at", "revision", "runtime_ms")) -> DataFrame:
    """K3: rows that differ, volatile columns aside."""
    values = [c for c in committed.columns if c not in keys and c not in volatile]
    return replay(committed, rebuilt, keys, values)


def cell(value: object, digits: int = 3) -> str:
    """K4: a table cell: rates to three decimals, characters that would break the table taken out."""
    if value is None:
        return "-"
    if isinstance(value, float):
        return f"{value:.{digits}f}"
    return "".join(c for c in str(value) if c.isprintable() and c not in "|`<>")


def markdown(df: DataFrame, title: str, most_rows: int = 500) -> str:
    """K4: a summary table as Markdown. Summaries are small; a longer table is refused, not cut."""
    rows = df.limit(most_rows + 1).collect()
    if len(rows) > most_rows:
        raise ValueError(f"a report has at most {most_rows} rows")
    head = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join([*head, *["| " + " | ".join(cell(v) for v in r) + " |" for r in rows]]) + "\n"


def pages(df: DataFrame, key: str, path: str) -> None:
    """K5: one JSON document per page: rows of a page gathered, each page's documents below its key."""
    body = F.to_json(F.struct(*sorted(c for c in df.columns if c != key)), {"ignoreNullFields": "false"})
    gathered = df.groupBy(key).agg(F.array_sort(F.collect_list(body)).alias("_rows"))
    gathered.select(key, F.concat(F.lit("["), F.array_join("_rows", ","), F.lit("]")).alias("value")).write.mode("overwrite").partitionBy(key).text(path)
