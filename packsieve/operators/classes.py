"""Answer classes, nearest targets, cross-tabs and tallies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Targets that an item may be in for sets to meet on it at once.
COMMON = 1000


def first_class(rules: Sequence[tuple[str, Column]], otherwise: str) -> Column:
    """The first class, in a registered order, whose test holds."""
    out = F.when(F.coalesce(rules[0][1], F.lit(False)), rules[0][0])
    for name, test in rules[1:]:
        out = out.when(F.coalesce(test, F.lit(False)), name)
    return out.otherwise(otherwise)


def contained(a: Column, b: Column) -> Column:
    """Every element of a is in b."""
    return F.size(F.array_except(a, b)) == 0


def symmetric_difference(a: Column, b: Column) -> Column:
    """How many elements only one of them has."""
    return F.size(F.array_union(a, b)) - F.size(F.array_intersect(a, b))


def nearest(answers: DataFrame, targets: DataFrame, answer: str, target: str, items: str) -> DataFrame:
    """Per answer the target with most shared items, then the smallest symmetric difference, then the smallest name.

    Equal sets are compared once. Sets meet on items that at most ``COMMON`` targets have;
    only answers whose best so far shares no more than they have of other items meet the
    targets on these too. Answers that share none with any target all have the same one: that
    of the fewest items. No targets at all are refused.
    """
    sets = lambda df, name: df.select(name, F.array_sort(F.array_distinct(items)).alias("_set"))
    a, t = sets(answers, answer), sets(targets, target).groupBy("_set").agg(F.min(target).alias(target))
    default = t.agg(F.min(F.struct(F.size("_set").alias("n"), F.col(target).alias("t"))).alias("m")).first().m
    if default is None:
        raise ValueError("there are no targets")
    common = t.select(F.explode("_set").alias("_i")).groupBy("_i").agg(F.count("*").alias("n")).where(F.col("n") > COMMON).select("_i", F.lit(True).alias("_common"))
    alike = a.select("_set").distinct()
    each = lambda df, *names: df.select(*names, F.explode("_set").alias("_i"))

    def best(met: DataFrame) -> DataFrame:
        """(_set, m): the best target of each set among the pairs (_set, target) that met."""
        of = t.select(target, F.col("_set").alias("_t"))
        both = F.size(F.array_intersect("_set", "_t"))
        rated = met.distinct().join(of, target).select("_set", both.alias("s"), (F.size("_set") + F.size("_t") - 2 * both).alias("apart"), target)
        return rated.groupBy("_set").agg(F.min(F.struct((-F.col("s")).alias("s"), F.col("apart").alias("apart"), F.col(target).alias("t"))).alias("m"))

    marked = each(alike, "_set").join(common, "_i", "left")
    first = best(marked.where("_common is null").join(each(t, target), "_i").select("_set", target))
    # what only common items connect shares no more than the answer has of these
    most = marked.groupBy("_set").agg(F.count("_common").alias("_most")).join(first, "_set", "left")
    open_ = most.where((F.col("_most") > 0) & (F.coalesce(-F.col("m.s"), F.lit(0)) <= F.col("_most"))).select("_set")
    again = best(each(open_, "_set").join(each(t, target), "_i").select("_set", target))
    found = first.join(open_, "_set", "left_anti").unionByName(again)
    return a.join(found, "_set", "left").select(
        answer, F.coalesce("m.t", F.lit(default.t)).alias(target), F.coalesce(-F.col("m.s"), F.lit(0)).alias("shared"), F.coalesce("m.apart", F.size("_set") + default.n).alias("apart")
    )


def cross_tab(rows: DataFrame, group: Sequence[str], row: str, column: str, columns: Sequence[str]) -> DataFrame:
    """Counts of row x column with named columns, zeros included, and totals over rows (row null)."""
    return rows.groupingSets([[*map(F.col, group), F.col(row)], [*map(F.col, group)]], *group, row).agg(*[F.count_if(F.col(column) == c).alias(c) for c in columns])


def judge_cuts(rows: DataFrame, judge: str, judged: str) -> DataFrame:
    """Each rating once in the cut 'run', and once in 'self' or 'others' by whose answer was judged: adds ``cut``."""
    return rows.withColumn("cut", F.explode(F.array(F.lit("run"), F.when(F.col(judge) == F.col(judged), "self").otherwise("others"))))


def reused(shown: DataFrame, answered: DataFrame, item: str = "item_id") -> DataFrame:
    """Items whose answer has a (field, value) that their card shows. Both: item, field, value as text."""
    return answered.join(shown, [item, "field", "value"], "left_semi").select(item).distinct()


def value_key(value: Column, kind: Column) -> Column:
    """Values as text that compare equal: booleans as 0 and 1, whole floats as integers."""
    return F.when(kind == "boolean", F.when(F.lower(value) == "true", "1").otherwise("0")).when(
        (kind == "float") & (value.try_cast("double") == F.floor(value.try_cast("double"))), value.try_cast("double").cast("long").cast("string")
    ).otherwise(value)


def seed_mean(rows: DataFrame, keys: Sequence[str], case: str, value: str) -> DataFrame:
    """The mean over seeds of each case, then over cases."""
    per_case = rows.groupBy(*keys, case).agg(F.avg(value).alias("_m"))
    return per_case.groupBy(*keys).agg(F.avg("_m").alias("value"), F.count("*").alias("cases"))


def stratum_rate(cases: DataFrame, keys: Sequence[str], inside: str, good: str) -> DataFrame:
    """A rate inside a stratum as a ratio of sums, over the cases that have a share of it."""
    there = F.col(inside) > 0
    return cases.groupBy(*keys).agg(
        F.when(F.sum(F.when(there, F.col(inside))) > 0, F.sum(F.when(there, F.col(good))) / F.sum(F.when(there, F.col(inside)))).alias("value"), F.count_if(there).alias("cases")
    )


def class_counts(rows: DataFrame, cls: str, item: str) -> DataFrame:
    """How many, and the first item, of each class."""
    return rows.groupBy(cls).agg(F.count("*").alias("n"), F.min(item).alias("first_item"))


def spread(counts: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Smallest and largest over seeds."""
    return counts.groupBy(*keys).agg(F.min(value).alias(f"least_{value}"), F.max(value).alias(f"most_{value}"), F.count("*").alias("seeds"))


def copy_shares(rows: DataFrame, known: DataFrame, key: str, keys: Sequence[str], listed: Column, used: Column) -> DataFrame:
    """Per stratum, rows whose key the training rows have, and rows that use a field outside the listed ones."""
    marked = rows.withColumn("_unlisted", F.size(F.array_except(used, listed)) > 0).join(known.select(key).distinct().withColumn("_known", F.lit(True)), key, "left")
    return marked.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col("_known")).alias("copies"), F.count_if("_unlisted").alias("unlisted"))


def tallies(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Counts by each of several columns on its own, in one pass: (what, value, n)."""
    cells = F.array(*[F.struct(F.lit(b).alias("what"), F.col(b).cast("string").alias("value")) for b in by])
    return rows.select(F.inline(cells)).groupBy("what", "value").agg(F.count("*").alias("n"))
