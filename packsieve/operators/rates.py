"""Rates of cases with seeded bootstrap intervals, paired comparisons, censuses.

Items give a case's mean, cases give the rate, so a case with many items weighs
no more than another. Resamples depend on the number of cases alone; they are
drawn once for each number with Python's generator and kept as a weights table
(resample, case number, times drawn).
"""

from __future__ import annotations

import random
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# How intervals are drawn and when a comparison says something.
RESAMPLES, SEED, LOW, HIGH, DISCORDANT = 1000, 17, 0.025, 0.975, 10
COMPARISONS = (("C4", "C2"), ("C2", "C1"), ("C4", "C3"))
OUTCOMES = ("provider_failed", "malformed", "abstained", "false_ready", "invalid", "shortcut", "strong_exact", "silent_wrong")
ARMS = ("resample", "bare", "counterexample")
#: Draws come from one sequential generator, so the number of cases is bounded; beyond it a rate has no interval here.
MOST_CASES = 20_000
#: Draws that a task makes of its own.
TASK_DRAWS = 500_000
# Digits of reported rates and costs.
RATE_DIGITS, COST_DIGITS = 6, 8


def half_even(value: Column, digits: int = RATE_DIGITS) -> Column:
    """rounded to so many digits, ties to the even one."""
    return F.bround(value, digits)


def resample_weights(cases: int, resamples: int = RESAMPLES, seed: int = SEED) -> list[tuple[int, int, int]]:
    """(resample, case number, times drawn): ``int(random() * cases)`` drawn ``cases`` times for each resample."""
    if cases > MOST_CASES:
        raise ValueError(f"more than {MOST_CASES} cases")
    rng = random.Random(seed)
    return [(b, i, w) for b in range(resamples) for i, w in sorted(Counter(int(rng.random() * cases) for _ in range(cases)).items())]


def weights_table(spark: SparkSession, cases: int, resamples: int = RESAMPLES, seed: int = SEED) -> DataFrame:
    """``resample_weights`` as a table, drawn in tasks: each starts from the generator's state at its first resample.

    The driver runs the generator through once to find these states, numbers unused
    (``MOST_CASES`` and ``RESAMPLES`` bound them); numpy's generator takes Python's states and draws the same numbers.
    """
    if cases > MOST_CASES:
        raise ValueError(f"more than {MOST_CASES} cases")
    each = max(1, TASK_DRAWS // max(1, cases))
    _, key, _ = random.Random(seed).getstate()
    ahead, states = np.random.RandomState(), []
    ahead.set_state(("MT19937", np.array(key[:-1], dtype=np.uint32), key[-1]))
    for first in range(0, resamples, each):
        _, words, place, *_ = ahead.get_state()
        states.append((first, bytearray(words.astype("<u4").tobytes()), int(place)))
        ahead.random_sample(each * cases)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for first, words, place in zip(batch["first"], batch["words"], batch["place"], strict=True):
                rng = np.random.RandomState()
                rng.set_state(("MT19937", np.frombuffer(words, "<u4"), place))
                for b in range(first, min(first + each, resamples)):
                    no, weight = np.unique((rng.random_sample(cases) * cases).astype(np.int64), return_counts=True)
                    yield pd.DataFrame({"resample": b, "case_no": no, "weight": weight})

    starts = spark.createDataFrame(states, "first long, words binary, place int").repartition(max(1, len(states)), "first")
    return starts.mapInPandas(draw, "resample long, case_no long, weight long")


def case_means(items: DataFrame, value: Column, keys: Sequence[str], case: str = "case_id") -> DataFrame:
    """G3, first level: (keys, case, mean, items)."""
    return items.groupBy(*keys, case).agg(F.avg(value.cast("double")).alias("mean"), F.count("*").alias("items"))


def rate(means: DataFrame, keys: Sequence[str], mean: str = "mean") -> DataFrame:
    """G3, second level."""
    return means.groupBy(*keys).agg(F.avg(mean).alias("value"), F.count("*").alias("cases"))


def ratio(cases: DataFrame, keys: Sequence[str], numerator: str, denominator: str) -> DataFrame:
    """The ratio of sums of case means; a case missing on top counts 0; null where the sum below is not positive."""
    top, below = F.sum(F.coalesce(F.col(numerator), F.lit(0.0))), F.sum(F.coalesce(F.col(denominator), F.lit(0.0)))
    return cases.groupBy(*keys).agg(F.when(below > 0, top / below).alias("value"), F.count("*").alias("cases"))


def numbered(cases: DataFrame, case: str, keys: Sequence[str] = ()) -> DataFrame:
    """Case numbers from 0 in order of the case, as resamples count them; more than ``MOST_CASES`` fail, as one task numbers them."""
    no = F.row_number().over(Window.partitionBy(*keys).orderBy(case))
    return cases.withColumn("case_no", no).withColumn("case_no", F.when(F.col("case_no") > MOST_CASES, F.raise_error(F.lit(f"more than {MOST_CASES} cases")).cast("long")).otherwise(F.col("case_no") - 1).cast("long"))


def interval(cases: DataFrame, weights: DataFrame, keys: Sequence[str], numerator: str, denominator: str | None = None) -> DataFrame:
    """Low, high (nearest rank 2.5 and 97.5 per cent) and resamples_used, of a mean or of a ratio of sums.

    ``cases`` has case_no. Resamples whose denominator is 0 are left out.
    """
    num = F.sum(F.col("weight") * F.col(numerator))
    den = F.sum(F.col("weight") * F.col(denominator)) if denominator else F.sum("weight").cast("double")
    drawn = cases.join(weights, "case_no").groupBy(*keys, "resample").agg(F.when(den > 0, num / den).alias("r")).where("r is not null")
    rank = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY r)")
    return drawn.groupBy(*keys).agg(rank(LOW).alias("low"), rank(HIGH).alias("high"), F.count("*").alias("resamples_used"))


def paired(means: DataFrame, condition: str, pairs: Sequence[tuple[str, str]] = COMPARISONS, case: str = "case_id", mean: str = "mean") -> DataFrame:
    """Differences first - second by case, over the cases that both have: (first, second, case, diff)."""
    spark = means.sparkSession
    wanted = F.broadcast(spark.createDataFrame(list(pairs), "first string, second string"))  # a few names
    a = means.select(F.col(condition).alias("first"), case, F.col(mean).alias("_a")).join(wanted, "first")
    b = means.select(F.col(condition).alias("second"), case, F.col(mean).alias("_b"))
    return a.join(b, ["second", case]).select("first", "second", case, (F.col("_a") - F.col("_b")).alias("diff"))


def comparison(diffs: DataFrame, keys: Sequence[str] = ("first", "second")) -> DataFrame:
    """Mean difference, cases better on either side, and whether too few cases differ to say anything."""
    better, worse = F.count_if(F.col("diff") > 0), F.count_if(F.col("diff") < 0)
    return diffs.groupBy(*keys).agg(
        F.avg("diff").alias("difference"), better.alias("first_better"), worse.alias("second_better"), F.count("*").alias("cases"), (better + worse < DISCORDANT).alias("inconclusive")
    )


def comparison_interval(diffs: DataFrame, cases: DataFrame, weights: DataFrame, keys: Sequence[str] = ("first", "second"), case: str = "case_id") -> DataFrame:
    """``comparison`` with the interval of the difference and the number of cases that differ.

    ``cases``: case and case_no of every case of the run, whether or not both sides have it, as resamples count them.
    """
    drawn = interval(diffs.join(cases, case), weights, keys, "diff")
    out = comparison(diffs, keys).join(drawn, list(keys), "left")
    return out.withColumn("discordant", F.col("first_better") + F.col("second_better")).withColumns({c: half_even(F.col(c)) for c in ("difference", "low", "high")})


def arm_comparison(items: DataFrame, cases: DataFrame, weights: DataFrame, first: Column, second: Column, triggered: Column, model: str = "model", case: str = "case_id") -> DataFrame:
    """Two arms' repaired shares, paired on every case: one row.

    The difference is the sum of the cases' share differences, over models too, by the sum of their
    triggered shares, with its interval. A case differs when the arms repaired different numbers of its
    items, all models together (integers, no shares), and counts for the arm that repaired more.
    """
    n = F.count("*").cast("double")
    per_model = items.groupBy(model, case).agg(
        ((F.count_if(triggered & first) - F.count_if(triggered & second)) / n).alias("_diff"), (F.count_if(triggered) / n).alias("_triggered"), (F.count_if(triggered & first) - F.count_if(triggered & second)).alias("_margin")
    )
    per_case = per_model.groupBy(case).agg(F.sum("_diff").alias("_diff"), F.sum("_triggered").alias("_triggered"), F.sum("_margin").alias("_margin"))
    drawn = interval(per_case.join(cases, case), weights, [], "_diff", "_triggered")
    ahead, behind = F.count_if(F.col("_margin") > 0), F.count_if(F.col("_margin") < 0)
    below = F.sum("_triggered")
    point = per_case.agg(
        F.when(below > 0, F.sum("_diff") / below).alias("difference"), ahead.alias("first_better"), behind.alias("second_better"), (ahead + behind).alias("discordant"), (ahead + behind < DISCORDANT).alias("inconclusive")
    )
    both = point.withColumn("_one", F.lit(1)).join(drawn.withColumn("_one", F.lit(1)), "_one", "left").drop("_one")  # two single rows
    return both.withColumns({c: half_even(F.col(c)) for c in ("difference", "low", "high")})


def gold_recall(items: DataFrame, keys: Sequence[str], gold: str, hits: str, shown: str, case: str = "case_id") -> DataFrame:
    """Of the items measured (``hits`` not null, ``gold`` above 0): mean recall and full coverage over cases; least and most fields shown over all items."""
    measured = F.col(hits).isNotNull() & (F.col(gold) > 0)
    per_case = items.groupBy(*keys, case).agg(
        F.avg(F.when(measured, F.col(hits) / F.col(gold))).alias("_recall"), F.avg(F.when(measured, (F.col(hits) == F.col(gold)).cast("double"))).alias("_full"), F.min(shown).alias("_least"), F.max(shown).alias("_most")
    )
    return per_case.groupBy(*keys).agg(
        F.min("_least").alias("k_min"), F.max("_most").alias("k_max"), half_even(F.avg("_recall")).alias("mean_recall"), half_even(F.avg("_full")).alias("full_coverage")
    ).where("mean_recall is not null")


def reading(low: Column, high: Column, discordant: Column) -> Column:
    """G24: 'gain', 'loss' or 'inconclusive': the interval leaves out 0 and enough cases differ."""
    return F.when(discordant < DISCORDANT, "inconclusive").when(low > 0, "gain").when(high < 0, "loss").otherwise("inconclusive")


def census(rows: DataFrame, keys: Sequence[str], value: str, domain: Sequence[str]) -> DataFrame:
    """G1: a count for every value of a closed domain, zeros included: one aggregate, unpivoted."""
    wide = rows.groupBy(*keys).agg(*[F.count_if(F.col(value) == d).alias(f"n{i}") for i, d in enumerate(domain)])
    cells = F.array(*[F.struct(F.lit(d).alias(value), F.col(f"n{i}").alias("n")) for i, d in enumerate(domain)])
    return wide.select(*keys, F.inline(cells))


def refined_code(code: Column, http_status: Column, provider_code: Column, known: Sequence[str]) -> Column:
    """``code:http_NNN``, ``code:provider`` or the code; unknown provider codes become 'other'."""
    provider = F.when(provider_code.isin(*known), provider_code).otherwise("other")
    return F.when(http_status.isNotNull(), F.concat(code, F.lit(":http_"), http_status.cast("string"))).when(
        provider_code.isNotNull(), F.concat(code, F.lit(":"), provider)
    ).otherwise(code)


def transitions(first: DataFrame, second: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """How often each outcome of the first pass became each of the second, unchanged ones included."""
    a, b = first.select(*keys, F.col(value).alias("was")), second.select(*keys, F.col(value).alias("became"))
    return a.join(b, list(keys)).groupBy("was", "became").agg(F.count("*").alias("n"))


def noise_bound(flipped: Column) -> Column:
    """Twice the root of half the flips of both passes."""
    return 2 * F.sqrt(flipped / 2)


def within_noise(net: Column, flipped: Column) -> Column:
    """G16, on integers: net squared is at most twice the flips."""
    return net * net <= 2 * flipped


def usage(prompt: str, completion: str, latency: str, status: str, price_in: float, price_out: float) -> list[Column]:
    """Token sums over rows that have both counts, rows that lack one, cost, whether that is a lower bound, latency percentiles."""
    whole = F.col(prompt).isNotNull() & F.col(completion).isNotNull()
    p, c = F.coalesce(F.sum(F.when(whole, F.col(prompt))), F.lit(0)), F.coalesce(F.sum(F.when(whole, F.col(completion))), F.lit(0))
    done = F.when(F.col(status) == "completed", F.col(latency))
    rank = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY CASE WHEN {status} = 'completed' THEN {latency} END)")
    return [
        p.alias("prompt_tokens"), c.alias("completion_tokens"), F.count_if(~whole).alias("rows_without_counts"),
        ((p * price_in + c * price_out) / 1e6).alias("cost"), (F.count_if(~whole) > 0).alias("cost_is_lower_bound"),
        rank(0.5).alias("latency_p50"), rank(0.95).alias("latency_p95"), F.count(done).alias("completed"),
    ]


def pooled(shares: DataFrame, keys: Sequence[str], case: str, values: Sequence[str]) -> DataFrame:
    """Shares summed case by case over models."""
    return shares.groupBy(*keys, case).agg(*[F.sum(v).alias(v) for v in values])


def repair_shares(items: DataFrame, keys: Sequence[str], case: str, triggered: Column, repaired: Column) -> DataFrame:
    """(keys, case, triggered, repaired): a case's items that were tried and that came right, as shares of its items."""
    n = F.count("*").cast("double")
    return items.groupBy(*keys, case).agg((F.count_if(triggered) / n).alias("triggered"), (F.count_if(triggered & repaired) / n).alias("repaired"))


def summary(outcomes: DataFrame, conditions: Mapping[str, str] | None = None) -> DataFrame:
    """Every condition's rates in one pass over (condition, case, outcome, gold_status): two aggregates."""
    ready = F.col("gold_status") == "ready"
    flags = {
        "strong_exact": ready & (F.col("outcome") == "strong_exact"), "silent_wrong": ready & (F.col("outcome") == "silent_wrong"),
        "compile_valid": ready & F.col("outcome").isin("strong_exact", "silent_wrong", "shortcut"), "abstained": ready & (F.col("outcome") == "abstained"),
        "shortcut": ready & (F.col("outcome") == "shortcut"),
    }
    by_case = outcomes.groupBy("condition", "case_id").agg(
        F.count_if(ready).alias("ready_items"), F.count_if(~ready).alias("other_items"),
        *[F.count_if(f).cast("double").alias(n) for n, f in flags.items()], F.count_if(~ready & (F.col("outcome") == "abstained")).cast("double").alias("other_abstained"),
    )
    in_ready, in_other = F.col("ready_items") > 0, F.col("other_items") > 0
    return by_case.groupBy("condition").agg(
        F.count_if(in_ready).alias("ready_cases"), F.count_if(in_other).alias("other_cases"),
        *[F.avg(F.when(in_ready, F.col(n) / F.col("ready_items"))).alias(n) for n in flags],
        F.avg(F.when(in_other, F.col("other_abstained") / F.col("other_items"))).alias("other_abstained"),
    )
