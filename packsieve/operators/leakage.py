"""Overlap between tables of text, and gates on training rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packsieve.functions import text

# Words that must be shared in a row, and the rules by which a row is dropped, in order.
SHARED_WORDS = 8
RULES = ("compile", "dev_test_key", "duplicate_key", "shortcut", "dev_test_text", "degenerate", "dev_test_frames")


#: Runs of the smaller table up to which it is sent to every executor (32 bytes each).
BROADCAST_RUNS = 500_000
SALTS = 32


def grams(rows: DataFrame, key: str, column: str, n: int = SHARED_WORDS) -> DataFrame:
    """(key, gram, gram2): each n-gram of a row once, as two 64-bit hashes: what is shuffled is 16 bytes, not the words."""
    # the words are a column of their own: inside the lambda they would be found anew for every run
    words = rows.select(key, text.ascii_words(F.col(column)).alias("_w"))
    runs = words.select(key, F.explode(text.ngrams(F.col("_w"), n)).alias("_g"))
    return runs.select(key, F.xxhash64("_g").alias("gram"), F.xxhash64("_g", F.lit(1)).alias("gram2"))


def overlaps(a: DataFrame, b: DataFrame, a_key: str, b_key: str, a_text: str = "text", b_text: str = "text", n: int = SHARED_WORDS) -> DataFrame:
    """A3: pairs of rows that share n words in a row, with how many such runs.

    Meets on hashes of the runs. ``b`` is the smaller table: its runs are counted,
    and sent to every executor while there are at most ``BROADCAST_RUNS``, so the
    larger table is read without a shuffle; beyond that both sides are shuffled.
    """
    ga, gb = grams(a, a_key, a_text, n), grams(b, b_key, b_text, n)
    if gb.limit(BROADCAST_RUNS + 1).count() <= BROADCAST_RUNS:
        gb = F.broadcast(gb)
    return ga.join(gb, ["gram", "gram2"]).groupBy(a_key, b_key).agg(F.count("*").alias("shared_grams"))


def first_seen(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Marks rows whose key an earlier row has (``duplicate``), whatever later becomes of that row.

    ``key`` and ``order`` name columns; of rows equal in both, all are first or none. A key's
    first place comes from partial minima, and a null key is one like any other; rows meet
    it dealt over ``SALTS``, so a key with a third of all rows is no hot task.
    """
    place = F.struct(*order).alias("_order")
    keyed = rows.select("*", F.struct(*key).alias("_k"), place)
    first = keyed.groupBy("_k").agg(F.min("_order").alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    dealt = first.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = keyed.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(SALTS)).cast("int")).join(dealt, ["_k", "_salt"], "left")
    return met.withColumn("duplicate", F.coalesce(F.col("_order") != F.col("_first"), F.lit(False))).select(*rows.columns, "duplicate")


def drop_rule(flags: dict[str, Column]) -> Column:
    """A2: the first rule, in order, that drops a row; null for rows that stay."""
    out = None
    for rule in RULES:
        if rule in flags:
            test = F.coalesce(flags[rule], F.lit(False))
            out = F.when(test, rule) if out is None else out.when(test, rule)
    return out
