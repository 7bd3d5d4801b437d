"""Run logs: last attempts, spend, states, windows of time, bills."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Completed requests that a run needs, how near the best a winner may be, values listed of a set.
COMPLETED_FLOOR, WINNER_MARGIN, LISTED = 152, 4, 8
# Outcomes that a repair round takes up again, and the condition that it repairs.
TRIGGER, REPAIRED = ("silent_wrong", "invalid"), "C4"


def last_attempts(attempts: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Per key the last attempt's columns and how many there were: one partial aggregate, no sort of the log."""
    rest = [c for c in attempts.columns if c not in keys]
    at = F.struct(*order)
    return attempts.groupBy(*keys).agg(F.max_by(F.struct(*rest), at).alias("_last"), F.count("*").alias("attempts")).select(*keys, "attempts", "_last.*")


def state(status: Column, retryable: Column, attempts: Column, most: int) -> Column:
    """Settled, pending (a failure that may be tried again) or failed."""
    return F.when(status == "completed", "settled").when(retryable & (attempts < most), "pending").otherwise("failed")


def charge(cost_usd: Column, prompt: Column, completion: Column, most_in: float, most_out: float, ceiling: Column) -> Column:
    """micro-USD charged: the reported cost, or tokens at the highest prices, or the ceiling; rounded up."""
    exact = "decimal(24,6)"  # a double's noise would be rounded up to a whole unit
    return F.ceil(F.coalesce((cost_usd.cast("decimal(24,12)") * 1_000_000).cast(exact), (prompt * most_in + completion * most_out).cast(exact), ceiling.cast(exact))).cast("long")


def provider_key(name: Column) -> Column:
    """before the slash, lower case, letters and digits only."""
    return F.regexp_replace(F.lower(F.split_part(name, F.lit("/"), F.lit(1))), "[^0-9a-z]", "")


def repair_plan(outcomes: DataFrame, trigger: Sequence[str] = TRIGGER, condition: str = REPAIRED) -> DataFrame:
    """The items to be tried again, with the place that preparing gave them (``pos``); their order is that of ``pos``."""
    return outcomes.where((F.col("condition") == condition) & F.col("outcome").isin(*trigger)).select("item_id", "outcome", "pos")


def plan_differs(outcomes: DataFrame, plan: DataFrame) -> DataFrame:
    """Items that the trigger picks and the plan lacks, or the other way round, or at another place: (item_id, status)."""
    want, have = repair_plan(outcomes).select("item_id", F.col("pos").alias("_want"), F.lit(True).alias("_w")), plan.select("item_id", F.col("pos").alias("_have"), F.lit(True).alias("_h"))
    status = F.when(F.col("_h").isNull(), "missing").when(F.col("_w").isNull(), "added").when(~F.col("_want").eqNullSafe(F.col("_have")), "moved")
    return want.join(have, "item_id", "full").select("item_id", status.alias("status")).where("status is not null")


def listed(rows: DataFrame, keys: Sequence[str], value: str, most: int = LISTED) -> DataFrame:
    """Per key the first distinct values in order (``listed``), and how many there are (``distinct``).

    Of a key's values no more than ``most`` are ever held together: each task keeps its smallest
    before the shuffle. Keys without a value have an empty list; null keys are keys.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    keyed = rows.select(*[F.struct(F.col(k).alias("v")).alias(n) for k, n in zip(keys, names, strict=True)], F.col(value).alias("_v"))
    once = keyed.distinct()
    first = once.where("_v is not null").withColumn("_r", F.row_number().over(Window.partitionBy(*names).orderBy("_v"))).where(F.col("_r") <= most)
    lists = first.groupBy(*names).agg(F.array_sort(F.collect_list("_v")).alias("listed"))
    counts = once.groupBy(*names).agg(F.count("_v").alias("distinct"))
    out = counts.join(lists, names, "left").withColumn("listed", F.coalesce("listed", F.array().cast(lists.schema["listed"].dataType)))
    return out.select(*[F.col(f"{n}.v").alias(k) for k, n in zip(keys, names, strict=True)], "listed", "distinct")


def thinking(reasoning_present: Column, reasoning_tokens: Column) -> Column:
    """Any reasoning -> not_honoured; any count -> honoured; else uncontrolled."""
    return F.when(F.bool_or(reasoning_present), "not_honoured").when(F.count(reasoning_tokens) > 0, "honoured").otherwise("uncontrolled")


def slot_winner(counts: DataFrame, slot: str, count: str, rank: str, name: str, margin: int = WINNER_MARGIN) -> DataFrame:
    """Per slot the earliest listed of those within the margin of the best count."""
    best = counts.withColumn("_best", F.max(count).over(Window.partitionBy(slot)))
    return best.where(F.col("_best") - F.col(count) <= margin).groupBy(slot).agg(F.min_by(F.struct(name, count), rank).alias("_w")).select(slot, "_w.*")


def first_in_order(rows: DataFrame, group: Sequence[str], order: Sequence[Column], keep: Sequence[str]) -> DataFrame:
    """The row with the smallest order key, as a minimum of structs."""
    key = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    grouped = rows.groupBy(*group) if group else rows.groupBy()
    return grouped.agg(F.min_by(F.struct(*keep), key).alias("_w")).select(*group, "_w.*")


def most_frequent(rows: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """The most frequent value, ties to the smallest."""
    counts = rows.groupBy(*group, value).agg(F.count("*").alias("n"))
    return first_in_order(counts, group, [-F.col("n"), F.col(value)], [value, "n"])


def direction(source: Column, target: Column, client: Column) -> Column:
    """F22."""
    return F.when(source == client, "out").when(target == client, "in").otherwise("other")


def in_billed_hours(runs: DataFrame, hours: DataFrame, start: str, finish: str, lo: str = "lo", hi: str = "hi", bucket_seconds: int = 3600) -> DataFrame:
    """Runs that lie inside a billed span. Spans and runs meet on hours by equality, then the range is tested.

    A run outside of every span is left out; one that crosses a span's end does not lie inside it.
    """
    bucket = lambda c: F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / bucket_seconds)
    spans = hours.withColumn("_b", F.explode(F.sequence(bucket(lo), F.greatest(bucket(lo), F.ceil(F.unix_seconds(F.col(hi).cast("timestamp")) / bucket_seconds) - 1))))
    return runs.withColumn("_b", bucket(start)).join(spans, "_b").where((F.col(start) >= F.col(lo)) & (F.col(finish) < F.col(hi))).drop("_b")


def bill(rows: DataFrame, resource: str, cost: str, requests: Column | None = None) -> DataFrame:
    """Exact sums by resource and in all (resource null), and the cost of 1,000 requests where their number is given."""
    return rows.rollup(resource).agg(F.sum(cost).alias("cost"), *([] if requests is None else [(F.sum(cost) * 1000 / requests).alias("per_thousand")]))


def within_window(first: Column, second: Column, hours: int = 24) -> Column:
    """The second pass began within so many hours of the first."""
    return (second >= first) & (second <= first + F.make_dt_interval(hours=F.lit(hours)))


def gate(rows: DataFrame, run: str, status: str, floor: int = COMPLETED_FLOOR) -> DataFrame:
    """Per run requests, completed, failed; runs that completed too few are dropped."""
    done = F.count_if(F.col(status) == "completed")
    return rows.groupBy(run).agg(F.count("*").alias("requests"), done.alias("completed"), F.count_if(F.col(status) != "completed").alias("failed")).where(F.col("completed") >= floor)


def same_answer(rows: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """One row per key, or the conflict: keys whose rows disagree are marked."""
    distinct = F.count_distinct(F.struct(*values))
    return rows.groupBy(*keys).agg(*[F.min(v).alias(v) for v in values], F.count("*").alias("rows"), (distinct > 1).alias("conflict"))


def one_match(wanted: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How many rows each wanted key finds; anything but one is an error."""
    found = rows.groupBy(*keys).agg(F.count("*").alias("found"))
    return wanted.join(found, list(keys), "left").withColumn("found", F.coalesce("found", F.lit(0)))
