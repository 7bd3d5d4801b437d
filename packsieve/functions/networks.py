"""IPv4 addresses and networks as numbers (F9, F10, J10): every test is a range, which scans can use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def address(text: Column) -> Column:
    """Dotted quad -> long, null for anything else."""
    parts = F.transform(F.split(text, r"\."), lambda p: p.try_cast("long"))
    ok = F.rlike(text, F.lit(r"^\d{1,3}(\.\d{1,3}){3}$")) & F.forall(parts, lambda p: p <= 255)
    return F.when(ok, F.aggregate(parts, F.lit(0).cast("long"), lambda a, p: a * 256 + p))


def dotted(n: Column) -> Column:
    return F.concat_ws(".", *[F.shiftrightunsigned(n, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)])


def size(prefix: Column) -> Column:
    """Addresses in a network of this prefix length."""
    return F.pow(F.lit(2), 32 - prefix).cast("long")


def first(n: Column, prefix: Column) -> Column:
    return n - F.pmod(n, size(prefix))


def last(n: Column, prefix: Column) -> Column:
    return first(n, prefix) + size(prefix) - 1


def supernet(n: Column, prefix: Column) -> Column:
    return first(n, prefix)


def subnet(n: Column, prefix: Column, longer: Column, nth: Column) -> Column:
    """First address of the nth network of the longer prefix inside."""
    return first(n, prefix) + nth * size(longer)


def overlaps(lo_a: Column, hi_a: Column, lo_b: Column, hi_b: Column) -> Column:
    return (lo_a <= hi_b) & (lo_b <= hi_a)


def contains(lo: Column, hi: Column, n: Column) -> Column:
    return n.between(lo, hi)


def stated(text: Column) -> Column:
    """networks that a text writes as CIDR or in shorthand such as 10/8: array of (lo, hi)."""
    found = F.regexp_extract_all(text, F.lit(r"(?<![0-9.])(\d{1,3}(?:\.\d{1,3}){0,3}/\d{1,2})(?![0-9])"), F.lit(1))

    def one(w: Column) -> Column:
        octets, prefix = F.split(F.split_part(w, F.lit("/"), F.lit(1)), r"\."), F.split_part(w, F.lit("/"), F.lit(2)).try_cast("int")
        padded = F.array_join(F.slice(F.concat(octets, F.array(*[F.lit("0")] * 3)), 1, 4), ".")
        n = address(padded)
        return F.when(n.isNotNull() & (prefix <= 32), F.struct(first(n, prefix).alias("lo"), last(n, prefix).alias("hi")))

    return F.filter(F.transform(found, one), lambda s: s.isNotNull())


#: Ranges of one block; each pair of blocks is a task of its own.
BLOCK = 16_384


def overlapping(ranges: DataFrame, key: str, lo: str, hi: str, width: int) -> DataFrame:
    """(a, b) of the keys, a < b, of ranges that share a number.

    Ranges meet in buckets of ``width`` by equality, each pair in the first bucket that both reach. The pairs of
    crowded buckets grow with the square of their ranges, and so does the number of tasks: ranges are dealt over
    blocks of about ``BLOCK``, and every two blocks meet in a task or a few, so a task's work stays the same. The tasks' number is given, since
    Spark would choose it by the few bytes that are read, and neither side is broadcast to the one task that reads a small file.
    """
    blocks = -(-ranges.count() // BLOCK) or 1
    tasks = max(blocks * blocks, 2 * ranges.sparkSession.sparkContext.defaultParallelism)

    def cells(side: str, own: str, other: str) -> DataFrame:
        rows = ranges.select(F.col(key).alias(side), F.col(lo).alias(f"lo_{side}"), F.col(hi).alias(f"hi_{side}"), F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))).alias("cell"))
        dealt = rows.withColumn(own, F.pmod(F.xxhash64(side), F.lit(blocks)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        meet = ((F.col("cell") * blocks + F.col("block_a")) * blocks + F.col("block_b")).alias("meet")  # one number: a hash table of these is the fastest
        return dealt.select(side, f"lo_{side}", f"hi_{side}", F.col("cell").alias(f"cell_{side}"), meet).repartition(tasks, "meet")

    a, b = cells("a", "block_a", "block_b"), cells("b", "block_b", "block_a")
    pairs = a.hint("shuffle_hash").join(b, "meet").where((F.col("a") < F.col("b")) & overlaps(F.col("lo_a"), F.col("hi_a"), F.col("lo_b"), F.col("hi_b")))
    return pairs.where(F.col("cell_a") == F.floor(F.greatest("lo_a", "lo_b") / width)).select("a", "b")
