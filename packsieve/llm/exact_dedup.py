"""Operator 4: exact duplicates by progressive refinement, in DataFrame functions only.

Rows are grouped by the length of their normalised text, then by length and a
hash of its first characters; only rows of groups with two or more members are
read again and have their whole text hashed. Grouping columns are numbers.
Groups are counted with partial aggregates before the shuffle, and rows meet
their group in a join salted by row, so a group with a third of all rows is
dealt over ``SALTS`` partitions, which adaptive joins split further.

The keys of surviving groups are broadcast while they are fewer than
``BROADCAST_KEYS`` (16 bytes each), so that texts are not shuffled; beyond that
the second reading is a salted shuffle join.

Edge cases: a null text counts as empty; texts that differ only in runs of
ASCII white space are equal; of equal texts the smallest doc_id stays (a null
doc_id stays only if all of the group are null); rows that repeat both the text
and the smallest doc_id are one document told twice: ``find`` marks each kept
and ``drop`` leaves one; an empty table gives no rows; extra columns pass
through ``drop`` unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packsieve.llm import scratch

PREFIX_CHARS, SALTS, BROADCAST_KEYS = 256, 8, 1_000_000


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def text_sha256(text: Column) -> Column:
    return F.sha2(normalised(text).cast("binary"), 256)


def spread(rows: DataFrame, groups: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Joins rows to one row per group, each group's key dealt over ``SALTS`` partitions."""
    left = rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(SALTS)).cast("int"))
    right = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def numbers(text: Column) -> list[Column]:
    """What is known of a text before it is hashed whole: its length and a hash of its beginning."""
    norm = normalised(text)
    return [F.length(norm).cast("long").alias("_len"), F.xxhash64(F.substring(norm, 1, PREFIX_CHARS)).alias("_pre")]


def find(docs: DataFrame, payload: dict[str, Column] | None = None, copies_alone: bool = False) -> DataFrame:
    """doc_id, keep_id, group_size long, kept boolean and the payload: one row per row of ``docs``.

    ``payload`` names columns computed from ``docs`` that travel with a row. With
    ``copies_alone``, only rows that survive both refinements are returned (with _len
    and _pre too), and nothing but their lengths and beginnings is read of the others.
    """
    payload = payload or {}
    own = numbers(F.col("text"))
    carried = [c.alias(n) for n, c in payload.items()]
    thin = scratch.table(docs.select("doc_id", *own, *([] if copies_alone else carried)), "lengths")

    by_length = thin.groupBy("_len").count().where("count > 1").select("_len")
    by_prefix = scratch.table(
        spread(thin.select("doc_id", "_len", "_pre"), by_length, ["_len"], "left_semi")
        .groupBy("_len", "_pre").count().where("count > 1").select("_len", "_pre"),
        "prefixes",
    )
    keys, few = ["_len", "_pre"], by_prefix.count() <= BROADCAST_KEYS

    def meet(rows: DataFrame, how: str) -> DataFrame:
        return rows.join(F.broadcast(by_prefix), keys, how) if few else spread(rows, by_prefix, keys, how)

    told = ["_len", "_pre", *payload] if copies_alone else [*payload]
    survivors = scratch.table(
        meet(docs.select("doc_id", "text", *own, *carried), "left_semi")
        .select("doc_id", *told, text_sha256(F.col("text")).alias("_sha")),
        "survivors",
    )
    groups = survivors.groupBy("_sha").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    met = spread(survivors, groups, ["_sha"], "inner").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), *told
    )
    if copies_alone:
        return met
    alone = meet(thin, "left_anti").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), *payload
    )
    return alone.unionByName(met)


def without(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` but those of ``gone``, a written table of numbers: sent to every executor while it is small, so that texts stay where they are."""
    return rows.join(F.broadcast(gone) if gone.count() <= BROADCAST_KEYS else gone, keys, "left_anti")


def drop(docs: DataFrame) -> DataFrame:
    """``docs`` without exact copies: its columns, one row of each group.

    Rows are told apart by id, length and beginning; the whole text is hashed for those alone
    that survived both refinements.
    """
    keys, key = ["_id", "_len", "_pre", "_text_key"], F.xxhash64(normalised(F.col("text")))
    verdicts = scratch.table(
        find(docs, {"_text_key": key}, copies_alone=True).where("group_size > 1")
        .groupBy(F.struct("doc_id").alias("_id"), "_len", "_pre", "_text_key").agg(F.count("*").alias("_times"), F.first("kept").alias("_kept")),
        "verdicts",
    )
    # a hash is asked for only where id, length and beginning are those of a copy
    maybe = verdicts.select("_id", "_len", "_pre").distinct().withColumn("_maybe", F.lit(True))
    maybe = F.broadcast(maybe) if verdicts.count() <= BROADCAST_KEYS else maybe
    thin = docs.select(scratch.whole(docs), F.struct("doc_id").alias("_id"), *numbers(F.col("text")))
    keyed = thin.join(maybe, keys[:3], "left").withColumn("_text_key", F.when(F.col("_maybe"), F.xxhash64(normalised(F.col("_doc.text")))))
    left = without(keyed, verdicts.where("not _kept").select(*keys), keys)
    told_twice = verdicts.where("_kept and _times > 1").select(*keys)
    if told_twice.limit(1).count():
        once = left.join(told_twice, keys, "left_semi").dropDuplicates(keys)
        left = without(left, told_twice, keys).unionByName(once)
    return left.select("_doc.*")
