import random

import pytest
from pyspark.sql import functions as F

from packsieve.operators import classes, rates


def test_bootstrap_matches_hand_computed_interval(spark):
    values = [1, 1, 1, 0.5, 0.5, 0, 0, 0]
    cases = rates.numbered(spark.createDataFrame([(f"case-{i}", float(v)) for i, v in enumerate(values)], "case_id string, mean double"), "case_id")
    got = rates.interval(cases, rates.weights_table(spark, 8), [], "mean").first()
    assert (got.low, got.high, got.resamples_used) == (0.1875, 0.75, 1000)


def test_weights_are_pythons_draws():
    rng = random.Random(17)
    draws = [[int(rng.random() * 5) for _ in range(5)] for _ in range(3)]
    assert rates.resample_weights(5, 3) == [(b, i, d.count(i)) for b, d in enumerate(draws) for i in sorted(set(d))]
    with pytest.raises(ValueError, match="more than"):
        rates.resample_weights(rates.MOST_CASES + 1)


def test_case_means_weigh_cases_not_items(spark):
    items = spark.createDataFrame([("C1", "case-1", "e"), ("C1", "case-1", "s"), ("C1", "case-2", "e"), ("C1", "case-2", "e")], "condition string, case_id string, outcome string")
    assert rates.rate(rates.case_means(items, F.col("outcome") == "e", ["condition"]), ["condition"]).first().value == 0.75


def test_ratio_is_null_without_a_denominator(spark):
    rows = spark.createDataFrame([("a", None, 0.0), ("b", 1.0, 2.0), ("b", None, 2.0)], "k string, n double, d double")
    assert {r.k: r.value for r in rates.ratio(rows, ["k"], "n", "d").collect()} == {"a": None, "b": 0.25}


def test_noise_bound_golden(spark):
    row = spark.range(1).select(F.round(rates.noise_bound(F.lit(12)), 3).alias("a"), F.round(rates.noise_bound(F.lit(9)), 3).alias("b"), rates.within_noise(F.lit(2), F.lit(2)).alias("c"), rates.within_noise(F.lit(3), F.lit(4)).alias("d")).first()
    assert (row.a, row.b, row.c, row.d) == (4.899, 4.243, True, False)


def test_pool_golden(spark):
    """75 items tried over four models, 35, 21 and 4 repaired."""
    rows = [(arm, f"c{i % 40}", i < n) for arm, n in (("counterexample", 35), ("bare", 21), ("resample", 4)) for i in range(75)]
    items = spark.createDataFrame(rows, "arm string, case_id string, repaired boolean")
    per = items.groupBy("arm", "case_id").agg(F.count("*").cast("double").alias("triggered"), F.count_if("repaired").cast("double").alias("repaired"))
    got = {r.arm: round(r.value, 3) for r in rates.ratio(rates.pooled(per, ["arm"], "case_id", ["triggered", "repaired"]), ["arm"], "repaired", "triggered").collect()}
    assert got == {"counterexample": 0.467, "bare": 0.28, "resample": 0.053}


def test_nearest_rank(spark):
    r = spark.range(1, 1001).select(F.expr("percentile_disc(0.025) within group (order by id)").alias("a"), F.expr("percentile_disc(0.975) within group (order by id)").alias("b")).first()
    assert (r.a, r.b) == (25, 975)


def test_census_is_zero_filled_and_reading_needs_enough_cases(spark):
    rows = spark.createDataFrame([("C1", "strong_exact")], "condition string, outcome string")
    got = {r.outcome: r.n for r in rates.census(rows, ["condition"], "outcome", rates.OUTCOMES).collect()}
    assert len(got) == 8 and sum(got.values()) == 1
    r = spark.range(1).select(*[rates.reading(F.lit(a), F.lit(b), F.lit(n)).alias(f"r{i}") for i, (a, b, n) in enumerate([(0.1, 0.2, 9), (0.1, 0.2, 10), (-0.2, -0.1, 10), (-0.1, 0.1, 50)])]).first()
    assert list(r) == ["inconclusive", "gain", "loss", "inconclusive"]


def test_value_keys_compare_equal(spark):
    r = spark.range(1).select(*[classes.value_key(F.lit(v), F.lit(k)).alias(f"c{i}") for i, (v, k) in enumerate([("true", "boolean"), ("3.0", "float"), ("3.5", "float"), ("x", "string")])]).first()
    assert list(r) == ["1", "3", "3.5", "x"]


def test_weights_in_tasks_are_those_of_one_generator(spark, monkeypatch):
    monkeypatch.setattr(rates, "TASK_DRAWS", 40)
    for cases in (1, 7, 13):
        got = sorted(map(tuple, rates.weights_table(spark, cases, 30).collect()))
        assert got == sorted(rates.resample_weights(cases, 30))
    monkeypatch.setattr(rates, "MOST_CASES", 3)
    with pytest.raises(ValueError, match="more than 3"):
        rates.weights_table(spark, 4)
    many = spark.createDataFrame([(i,) for i in range(4)], "case_id long")
    assert [r.case_no for r in rates.numbered(many.limit(3), "case_id").orderBy("case_no").collect()] == [0, 1, 2]
    with pytest.raises(Exception, match="more than 3 cases"):
        rates.numbered(many, "case_id").collect()


@pytest.mark.parametrize("common", [0, 2, 1000])
def test_nearest_target_is_that_of_all_pairs_whatever_is_common(spark, monkeypatch, common):
    monkeypatch.setattr(classes, "COMMON", common)
    rng = random.Random(6)
    words = ["the", "of", *(f"w{i}" for i in range(12))]
    made = lambda n: [(i, rng.sample(words, rng.randint(0, 4)) + ["the"] * rng.randint(0, 1)) for i in range(n)]
    answers, targets = made(60), made(15)
    got = {r.answer: (r.target, r.shared, r.apart) for r in classes.nearest(spark.createDataFrame(answers, "answer long, items array<string>"), spark.createDataFrame(targets, "target long, items array<string>"), "answer", "target", "items").collect()}
    for k, items in answers:
        a = set(items)
        want = min(((-len(a & set(t)), len(a ^ set(t)), i) for i, t in targets))
        assert (got[k][1], got[k][2]) == (-want[0], want[1]) and (got[k][0] == want[2] or not want[0]), (k, items, got[k], want)
