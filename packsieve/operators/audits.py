"""Audit queries: they return what is wrong, so an empty result is a pass."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packsieve.operators.matching import replay


def kill_matrix(frames: DataFrame, expected: Column, hits: dict[str, Column], probe: str, case: Sequence[str] = ()) -> DataFrame:
    """Per mutant and probe, whether its set differs from the expected one. One scan, counts only."""
    names = list(hits)
    wide = frames.groupBy(*case, probe).agg(*[F.bool_or(expected != hits[n]).alias(f"k{i}") for i, n in enumerate(names)])
    return wide.select(*case, probe, F.inline(F.array(*[F.struct(F.lit(n).alias("mutant"), F.col(f"k{i}").alias("killed")) for i, n in enumerate(names)])))


def survivors(kills: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mutants that no probe kills."""
    return kills.groupBy(*keys).agg(F.bool_or("killed").alias("killed"), F.count_if("killed").alias("killing_probes")).where("not killed").drop("killed")


def waived(found: DataFrame, waivers: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Survivors without a waiver, and waivers that no longer match a survivor."""
    return found.join(waivers.select(*keys), list(keys), "left_anti"), waivers.join(found.select(*keys), list(keys), "left_anti")


def mutation_census(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Counts by every combination of ``by``, totals included (null stands for all)."""
    return rows.cube(*by).agg(F.count("*").alias("n"), F.count_if("waived").alias("waived"), F.count_if(~F.col("waived")).alias("unwaived"))


def listed_against_found(manifest: DataFrame, found: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Entries missing, extra or changed, either way round."""
    return replay(manifest, found, keys, values)


def not_admitted(rows: DataFrame, open_split: Column, allowed: DataFrame, digest: str) -> DataFrame:
    """Held-out rows whose digest is not on the list; rows of the open split pass."""
    return rows.where(~open_split).join(allowed.select(digest), digest, "left_anti")


def recomputed(rows: DataFrame, derived: dict[str, Column]) -> DataFrame:
    """A10: rows whose stored value differs from the recomputed one."""
    test = F.lit(False)
    for name, value in derived.items():
        test = test | ~F.col(name).eqNullSafe(value)
    return rows.where(test)


def out_of_order(plan: DataFrame, position: str, listed: str, group: Sequence[str] = ()) -> DataFrame:
    """Rows of a plan whose listed position does not come after the row's before: no ordered subsequence."""
    w = Window.partitionBy(*group).orderBy(position)
    return plan.withColumn("_before", F.lag(listed).over(w)).where(F.col("_before") >= F.col(listed)).drop("_before")


def zipped(a: DataFrame, b: DataFrame, keys: Sequence[str], left: str, right: str) -> DataFrame:
    """Two array columns side by side by place; a place that one lacks is null, so lengths can be compared."""
    rows = a.select(*keys, F.col(left).alias("_l")).join(b.select(*keys, F.col(right).alias("_r")), list(keys))
    zipped_ = F.arrays_zip("_l", "_r")
    return rows.select(*keys, F.posexplode(zipped_).alias("pos", "z")).select(*keys, "pos", F.col("z._l").alias(left), F.col("z._r").alias(right))


def same_members(rows: DataFrame, row: str, member: str) -> DataFrame:
    """Members that not every row (group) has, with how many have them."""
    have = rows.groupBy(member).agg(F.count_distinct(row).alias("groups"))
    total = F.broadcast(rows.agg(F.count_distinct(row).alias("_total")))  # one row
    return have.join(total, F.col("groups") < F.col("_total")).drop("_total")


def settings_differ(rows: DataFrame, registered: dict[str, object], keys: Sequence[str]) -> DataFrame:
    """Per row and setting whose value isn't the registered one: (keys, setting, registered, found), values as text."""
    cells = [F.struct(F.lit(n).alias("setting"), F.lit(v).cast("string").alias("registered"), F.col(n).cast("string").alias("found")) for n, v in registered.items()]
    return rows.select(*keys, F.inline(F.array(*cells))).where(~F.col("registered").eqNullSafe(F.col("found")))


def exactly_once(rows: DataFrame, anchor: str) -> DataFrame:
    """Anchors that don't have exactly one row, with how many they have."""
    return rows.groupBy(anchor).agg(F.count("*").alias("n")).where("n <> 1")


def reconciled(manifests: dict[str, DataFrame], anchor: str, digest: str) -> DataFrame:
    """Anchors that are not exactly once, and with one digest, in each of several manifests: (anchor, missing, repeated, differs).

    The manifests are one tagged union and meet in one aggregate: a bit for each that has the
    anchor, a bit for each that has it again, and the least and greatest digest. A null digest is one like any other.
    """
    tagged = [df.select(F.col(anchor), F.coalesce(digest, F.lit("")).alias("_d"), F.lit(1 << i).cast("long").alias("_side")) for i, df in enumerate(manifests.values())]
    rows = functools.reduce(DataFrame.unionByName, tagged)
    per = rows.groupBy(anchor, "_side").agg(F.count("*").alias("_n"), F.min("_d").alias("_low"), F.max("_d").alias("_high"))
    met = per.groupBy(anchor).agg(F.bit_or("_side").alias("_has"), F.bit_or(F.when(F.col("_n") > 1, F.col("_side")).otherwise(0)).alias("_again"), (F.min("_low") != F.max("_high")).alias("differs"))
    names = lambda mask, value: F.array_compact(F.array(*[F.when(mask.bitwiseAND(1 << i).cast("boolean") == value, F.lit(n)) for i, n in enumerate(manifests)]))
    every = (1 << len(manifests)) - 1
    return met.where((F.col("_has") != every) | (F.col("_again") != 0) | F.col("differs")).select(anchor, names(F.col("_has"), False).alias("missing"), names(F.col("_again"), True).alias("repeated"), "differs")


def suite(kills: DataFrame, case: str, killed: Column, first: Column) -> DataFrame:
    """Cases, those that any probe kills and those that the first probe alone kills: one row."""
    per = kills.groupBy(case).agg(F.bool_or(killed).alias("_any"), F.coalesce(F.bool_or(F.when(first, killed)), F.lit(False)).alias("_first"))
    return per.agg(F.count("*").alias("cases"), F.count_if("_any").alias("killed"), F.count_if("_first").alias("killed_by_first"))


def not_exact_gold(metrics: DataFrame, case: Sequence[str]) -> DataFrame:
    """Gold whose own predicate is not exact on each probe, or expects nothing anywhere."""
    return metrics.groupBy(*case).agg(F.bool_and("exact").alias("exact"), F.max("n_expected").alias("most_expected")).where(~F.col("exact") | (F.col("most_expected") == 0))


def unstable(first: DataFrame, second: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Matches of one of two executions only."""
    return replay(first, second, keys, [])
