"""Queries of rates, intervals, comparisons, transitions, repair and judge tables.

Orders stand for scored items: the customer is the case, the priority the
condition, the status the outcome.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packsieve.operators import classes, rates
from packsieve.plans.frames import table

QUERIES, SQL = {}, {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            SQL[name] = oracle
        return f

    return add


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("C"), (n % 4 + 1).cast("string")).alias("condition"), F.col("o_custkey").alias("case_id"), n.alias("item_id"),
        F.when(F.col("o_orderstatus") == "F", "strong_exact").when(F.col("o_orderstatus") == "O", "silent_wrong").otherwise(F.when(n % 3 == 0, "shortcut").when(n % 3 == 1, "abstained").otherwise("invalid")).alias("outcome"),
        F.when(n % 5 == 0, F.when(n % 10 == 0, "needs_clarification").otherwise("not_expressible")).otherwise("ready").alias("gold_status"),
        "o_totalprice", "o_orderpriority", "o_orderdate",
    )


O = """o AS (SELECT 'C' || (o_orderkey % 4 + 1) AS condition, o_custkey AS case_id, o_orderkey AS item_id,
    CASE o_orderstatus WHEN 'F' THEN 'strong_exact' WHEN 'O' THEN 'silent_wrong' ELSE CASE o_orderkey % 3 WHEN 0 THEN 'shortcut' WHEN 1 THEN 'abstained' ELSE 'invalid' END END AS outcome,
    CASE WHEN o_orderkey % 5 = 0 THEN CASE WHEN o_orderkey % 10 = 0 THEN 'needs_clarification' ELSE 'not_expressible' END ELSE 'ready' END AS gold_status, o_totalprice, o_orderpriority, o_orderdate FROM orders)"""
_domain = ", ".join(f"('{d}')" for d in rates.OUTCOMES)


@query("outcome_census", f"""WITH {O}, c AS (SELECT DISTINCT condition FROM o), d AS (SELECT * FROM (VALUES {_domain}) t(outcome))
    SELECT c.condition, d.outcome, count(o.outcome) AS n FROM c CROSS JOIN d LEFT JOIN o ON o.condition = c.condition AND o.outcome = d.outcome GROUP BY ALL""")
def outcome_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1."""
    return rates.census(outcomes(spark, sf_dir), ["condition"], "outcome", rates.OUTCOMES)


@query("error_refinement", """SELECT CASE WHEN o_orderkey % 7 < 2 THEN 'request_failed:http_' || (400 + o_orderkey % 7 * 29) WHEN o_orderkey % 7 < 4 THEN 'request_failed:' || CASE WHEN o_orderkey % 3 = 0 THEN 'overloaded' ELSE 'other' END
    ELSE 'request_failed' END AS code, count(*) AS n FROM orders GROUP BY 1""")
def error_refinement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G2."""
    n = F.col("o_orderkey")
    code = rates.refined_code(
        F.lit("request_failed"), F.when(n % 7 < 2, 400 + n % 7 * 29), F.when((n % 7 >= 2) & (n % 7 < 4), F.when(n % 3 == 0, "overloaded").otherwise(F.concat(F.lit("p"), (n % 50).cast("string")))), ["overloaded"]
    )
    return table(spark, sf_dir, "orders").groupBy(code.alias("code")).agg(F.count("*").alias("n"))


def means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates.case_means(outcomes(spark, sf_dir), F.col("outcome") == "strong_exact", ["condition"])


MEANS = "m AS (SELECT condition, case_id, avg(CASE WHEN outcome = 'strong_exact' THEN 1.0 ELSE 0.0 END) AS mean, count(*) AS items FROM o GROUP BY ALL)"


@query("case_rates", f"WITH {O}, {MEANS} SELECT condition, round(avg(mean), 6) AS value, count(*) AS cases FROM m GROUP BY condition")
def case_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G3."""
    return rates.rate(means(spark, sf_dir), ["condition"]).withColumn("value", F.round("value", 6))


def both_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = outcomes(spark, sf_dir)
    wrong = rates.case_means(rows.where("outcome = 'silent_wrong' and item_id % 3 > 0"), F.lit(1.0), ["condition"]).select("condition", "case_id", F.col("mean").alias("wrong"))
    ran = rates.case_means(rows, F.col("outcome").isin("strong_exact", "silent_wrong"), ["condition"]).select("condition", "case_id", F.col("mean").alias("ran"))
    return ran.join(wrong, ["condition", "case_id"], "left")


@query("ratio_rate", f"""WITH {O}, w AS (SELECT DISTINCT condition, case_id, 1.0::DOUBLE AS wrong FROM o WHERE outcome = 'silent_wrong' AND item_id % 3 > 0),
    r AS (SELECT condition, case_id, avg(CASE WHEN outcome IN ('strong_exact', 'silent_wrong') THEN 1.0 ELSE 0.0 END) AS ran FROM o GROUP BY ALL)
    SELECT r.condition, round(CASE WHEN sum(ran) > 0 THEN sum(coalesce(wrong, 0)) / sum(ran) END, 6) AS value, count(*) AS cases FROM r LEFT JOIN w ON r.condition = w.condition AND r.case_id = w.case_id GROUP BY r.condition""")
def ratio_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G4, J4."""
    return rates.ratio(both_means(spark, sf_dir), ["condition"], "wrong", "ran").withColumn("value", F.round("value", 6))


# A bootstrap over 25 cases (nations): integers as numerators, so that sums are exact.
_WEIGHTS25 = "w AS (SELECT split_part(x, ':', 1)::BIGINT AS resample, split_part(x, ':', 2)::BIGINT AS case_no, split_part(x, ':', 3)::BIGINT AS weight FROM (SELECT unnest(string_split('{}', ',')) AS x))".format(
    ",".join(f"{b}:{i}:{w}" for b, i, w in rates.resample_weights(25))
)


@query("bootstrap_ci", f"""WITH s AS (SELECT n_nationkey AS case_id, count(c_custkey) FILTER (c_acctbal > 4000) AS good, count(c_custkey) AS items FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1),
    c AS (SELECT *, row_number() OVER (ORDER BY case_id) - 1 AS case_no FROM s),
    {_WEIGHTS25},
    r AS (SELECT resample, sum(weight * good) / sum(weight * items)::DOUBLE AS r FROM c JOIN w USING (case_no) GROUP BY 1 HAVING sum(weight * items) > 0)
    SELECT round(quantile_disc(r, 0.025), 6) AS low, round(quantile_disc(r, 0.975), 6) AS high, count(*) AS resamples_used FROM r""")
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G5, G6."""
    c = table(spark, sf_dir, "customer")
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("case_id"))
    per = n.join(c.groupBy(F.col("c_nationkey").alias("case_id")).agg(F.count_if(F.col("c_acctbal") > 4000).alias("good"), F.count("*").alias("items")), "case_id", "left").fillna(0)
    cases = rates.numbered(per, "case_id")
    out = rates.interval(cases, rates.weights_table(spark, 25), [], "good", "items")
    return out.withColumns({k: F.round(k, 6) for k in ("low", "high")})


@query("paired_comparison", f"""WITH {O}, {MEANS}, p AS (SELECT * FROM (VALUES ('C4', 'C2'), ('C2', 'C1'), ('C4', 'C3')) t(first, second)),
    d AS (SELECT first, second, a.mean - b.mean AS diff FROM p JOIN m a ON a.condition = first JOIN m b ON b.condition = second AND a.case_id = b.case_id)
    SELECT first, second, round(avg(diff), 6) AS difference, count(*) FILTER (diff > 0) AS first_better, count(*) FILTER (diff < 0) AS second_better, count(*) AS cases,
        count(*) FILTER (diff <> 0) < 10 AS inconclusive FROM d GROUP BY ALL""")
def paired_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G7, J3."""
    return rates.comparison(rates.paired(means(spark, sf_dir), "condition")).withColumn("difference", F.round("difference", 6))


NATIONS = "k AS (SELECT n_nationkey AS case_id, row_number() OVER (ORDER BY n_nationkey) - 1 AS case_no FROM nation)"


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates.numbered(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("case_id")), "case_id")


@query("comparison_ci", f"""WITH {O}, m AS (SELECT condition, c_nationkey AS case_id, avg(CASE WHEN outcome = 'strong_exact' THEN 1.0 ELSE 0.0 END) AS mean FROM o JOIN customer ON c_custkey = o.case_id GROUP BY ALL), {NATIONS}, {_WEIGHTS25},
    p AS (SELECT * FROM (VALUES ('C4', 'C2'), ('C2', 'C1'), ('C4', 'C3')) t(first, second)),
    d AS (SELECT first, second, a.case_id, a.mean - b.mean AS diff FROM p JOIN m a ON a.condition = first JOIN m b ON b.condition = second AND a.case_id = b.case_id),
    r AS (SELECT first, second, resample, sum(weight * diff) / sum(weight) AS r FROM d JOIN k USING (case_id) JOIN w USING (case_no) GROUP BY ALL HAVING sum(weight) > 0),
    i AS (SELECT first, second, quantile_disc(r, 0.025) AS low, quantile_disc(r, 0.975) AS high, count(*) AS resamples_used FROM r GROUP BY ALL),
    c AS (SELECT first, second, avg(diff) AS difference, count(*) FILTER (diff > 0) AS first_better, count(*) FILTER (diff < 0) AS second_better, count(*) AS cases, count(*) FILTER (diff <> 0) AS discordant FROM d GROUP BY ALL)
    SELECT first, second, round_even(difference, 6) AS difference, round_even(low, 6) AS low, round_even(high, 6) AS high, resamples_used, first_better, second_better, cases, discordant, discordant < 10 AS inconclusive FROM c JOIN i USING (first, second)""")
def comparison_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customer's nation is the case."""
    of = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("case_id"), F.col("c_nationkey").alias("nation"))
    items = outcomes(spark, sf_dir).join(of, "case_id").drop("case_id").withColumnRenamed("nation", "case_id")
    diffs = rates.paired(rates.case_means(items, F.col("outcome") == "strong_exact", ["condition"]), "condition")
    return rates.comparison_interval(diffs, nations(spark, sf_dir), rates.weights_table(spark, 25))


@query("arm_comparison", f"""WITH i AS (SELECT l_suppkey % 3 AS model, s_nationkey AS case_id, l_quantity > 30 AS triggered, l_quantity > 30 AND l_discount > 0.05 AS a, l_quantity > 30 AND l_tax > 0.04 AS b FROM lineitem JOIN supplier ON s_suppkey = l_suppkey), {NATIONS}, {_WEIGHTS25},
    s AS (SELECT model, case_id, (count(*) FILTER (a) - count(*) FILTER (b)) / count(*)::DOUBLE AS diff, count(*) FILTER (triggered) / count(*)::DOUBLE AS tried, count(*) FILTER (a) - count(*) FILTER (b) AS margin FROM i GROUP BY ALL),
    c AS (SELECT case_id, sum(diff) AS diff, sum(tried) AS tried, sum(margin) AS margin FROM s GROUP BY 1),
    r AS (SELECT resample, sum(weight * diff) / sum(weight * tried) AS r FROM c JOIN k USING (case_id) JOIN w USING (case_no) GROUP BY 1 HAVING sum(weight * tried) > 0),
    x AS (SELECT quantile_disc(r, 0.025) AS low, quantile_disc(r, 0.975) AS high, count(*) AS resamples_used FROM r)
    SELECT round_even(sum(diff) / sum(tried), 6) AS difference, any_value(round_even(low, 6)) AS low, any_value(round_even(high, 6)) AS high, any_value(resamples_used) AS resamples_used,
        count(*) FILTER (margin > 0) AS first_better, count(*) FILTER (margin < 0) AS second_better, count(*) FILTER (margin <> 0) AS discordant, count(*) FILTER (margin <> 0) < 10 AS inconclusive FROM c, x""")
def arm_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The supplier's nation is the case."""
    of = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("case_id"))
    items = table(spark, sf_dir, "lineitem").join(of, "l_suppkey").withColumn("model", F.col("l_suppkey") % 3)
    return rates.arm_comparison(items, nations(spark, sf_dir), rates.weights_table(spark, 25), F.col("l_discount") > 0.05, F.col("l_tax") > 0.04, F.col("l_quantity") > 30)


@query("gold_recall", """WITH i AS (SELECT p_type AS condition, p_brand AS case_id, p_partkey % 5 AS gold, CASE WHEN p_partkey % 3 > 0 THEN p_size % (1 + p_partkey % 5) END AS hits, p_size AS shown FROM part),
    c AS (SELECT condition, case_id, avg(hits / gold::DOUBLE) FILTER (hits IS NOT NULL AND gold > 0) AS recall, avg(CAST(hits = gold AS INTEGER)) FILTER (hits IS NOT NULL AND gold > 0) AS whole, min(shown) AS least, max(shown) AS most FROM i GROUP BY ALL)
    SELECT condition, min(least) AS k_min, max(most) AS k_max, round_even(avg(recall), 6) AS mean_recall, round_even(avg(whole), 6) AS full_coverage FROM c GROUP BY 1 HAVING avg(recall) IS NOT NULL""")
def gold_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G10."""
    k = F.col("p_partkey")
    items = table(spark, sf_dir, "part").select(F.col("p_type").alias("condition"), F.col("p_brand").alias("case_id"), (k % 5).alias("gold"), F.when(k % 3 > 0, F.col("p_size") % (1 + k % 5)).alias("hits"), F.col("p_size").alias("shown"))
    return rates.gold_recall(items, ["condition"], "gold", "hits", "shown")


@query("noise_reading", """WITH t AS (SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F' AND o_orderkey % 3 = 0) AS gained, count(*) FILTER (o_orderstatus = 'O' AND o_orderkey % 7 = 0) AS lost FROM orders GROUP BY 1)
    SELECT o_orderpriority, gained, lost, round(2 * sqrt((gained + lost) / 2), 6) AS bound, (gained - lost) * (gained - lost) <= 2 * (gained + lost) AS within FROM t""")
def noise_reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G16."""
    s, k = F.col("o_orderstatus"), F.col("o_orderkey")
    t = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count_if((s == "F") & (k % 3 == 0)).alias("gained"), F.count_if((s == "O") & (k % 7 == 0)).alias("lost"))
    flipped, net = F.col("gained") + F.col("lost"), F.col("gained") - F.col("lost")
    return t.withColumn("bound", F.round(rates.noise_bound(flipped), 6)).withColumn("within", rates.within_noise(net, flipped))


@query("transitions", """SELECT a.role AS was, b.role AS became, count(*) AS n FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 GROUP BY ALL""")
def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The role of a turn and of the next one."""
    c = table(spark, sf_dir, "conversations")
    return rates.transitions(c.select("conv_id", (F.col("turn") + 1).alias("turn"), "role"), c, ["conv_id", "turn"], "role")


REPAIR = """i AS (SELECT l_suppkey % 3 AS model, l_partkey % 40 AS case_id, l_quantity > 30 AS triggered, l_discount > 0.05 AS repaired FROM lineitem),
    s AS (SELECT model, case_id, count(*) FILTER (triggered) / count(*)::DOUBLE AS triggered, count(*) FILTER (triggered AND repaired) / count(*)::DOUBLE AS repaired FROM i GROUP BY ALL)"""


def shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 3).alias("model"), (F.col("l_partkey") % 40).alias("case_id"), "l_quantity", "l_discount")
    return rates.repair_shares(rows, ["model"], "case_id", F.col("l_quantity") > 30, F.col("l_discount") > 0.05)


@query("repair_rate", f"WITH {REPAIR} SELECT model, round(CASE WHEN sum(triggered) > 0 THEN sum(repaired) / sum(triggered) END, 6) AS value, count(*) AS cases FROM s GROUP BY model")
def repair_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G17."""
    return rates.ratio(shares(spark, sf_dir), ["model"], "repaired", "triggered").withColumn("value", F.round("value", 6))


@query("repair_pool", f"""WITH {REPAIR}, p AS (SELECT case_id, sum(triggered) AS triggered, sum(repaired) AS repaired FROM s GROUP BY 1)
    SELECT round(sum(repaired) / sum(triggered), 6) AS value, count(*) AS cases FROM p""")
def repair_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G19."""
    pool = rates.pooled(shares(spark, sf_dir), [], "case_id", ["triggered", "repaired"])
    return rates.ratio(pool, [], "repaired", "triggered").withColumn("value", F.round("value", 6))


@query("nonready_grouping", """WITH x AS (SELECT d.lang, d.source, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
    SELECT lang, source, count(*) FILTER (quality = 1) AS q1, count(*) FILTER (quality = 0) AS q0 FROM x GROUP BY GROUPING SETS ((lang, source), (lang))""")
def nonready_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G9, G21."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").withColumn("q", F.concat(F.lit("q"), F.col("quality").cast("string")))
    return classes.cross_tab(rows, ["lang"], "source", "q", ["q1", "q0"])


_R = "outcome = '{0}'"


@query("condition_summary", f"""WITH {O}, c AS (SELECT condition, case_id, count(*) FILTER (gold_status = 'ready') AS r, count(*) FILTER (gold_status <> 'ready') AS x,
        {', '.join(f"count(*) FILTER (gold_status = 'ready' AND {t}) AS {n}" for n, t in {'strong_exact': "outcome = 'strong_exact'", 'silent_wrong': "outcome = 'silent_wrong'", 'compile_valid': "outcome IN ('strong_exact', 'silent_wrong', 'shortcut')", 'abstained': "outcome = 'abstained'", 'shortcut': "outcome = 'shortcut'"}.items())},
        count(*) FILTER (gold_status <> 'ready' AND outcome = 'abstained') AS xa FROM o GROUP BY ALL)
    SELECT condition, count(*) FILTER (r > 0) AS ready_cases, count(*) FILTER (x > 0) AS other_cases,
        {', '.join(f"round(avg(CASE WHEN r > 0 THEN {n} / r::DOUBLE END), 6) AS {n}" for n in ('strong_exact', 'silent_wrong', 'compile_valid', 'abstained', 'shortcut'))},
        round(avg(CASE WHEN x > 0 THEN xa / x::DOUBLE END), 6) AS other_abstained FROM c GROUP BY condition""")
def condition_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G8, G9."""
    out = rates.summary(outcomes(spark, sf_dir))
    return out.withColumns({n: F.round(n, 6) for n in ("strong_exact", "silent_wrong", "compile_valid", "abstained", "shortcut", "other_abstained")})


@query("usage_summary", """WITH u AS (SELECT event_type AS condition, CASE WHEN event_id % 9 > 0 THEN user_id * 10 END AS p, CASE WHEN event_id % 8 > 0 THEN user_id * 3 END AS c, value AS latency, CASE WHEN event_id % 4 > 0 THEN 'completed' ELSE 'failed' END AS status FROM events),
    s AS (SELECT condition, CAST(coalesce(sum(p) FILTER (p IS NOT NULL AND c IS NOT NULL), 0) AS BIGINT) AS prompt_tokens, CAST(coalesce(sum(c) FILTER (p IS NOT NULL AND c IS NOT NULL), 0) AS BIGINT) AS completion_tokens,
        count(*) FILTER (p IS NULL OR c IS NULL) AS rows_without_counts, quantile_disc(latency, 0.5) FILTER (status = 'completed') AS latency_p50, quantile_disc(latency, 0.95) FILTER (status = 'completed') AS latency_p95, count(*) FILTER (status = 'completed') AS completed FROM u GROUP BY 1)
    SELECT condition, prompt_tokens, completion_tokens, rows_without_counts, round((prompt_tokens * 0.25 + completion_tokens * 1.5) / 1e6, 6) AS cost, rows_without_counts > 0 AS cost_is_lower_bound, latency_p50, latency_p95, completed FROM s""")
def usage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G11-G13."""
    n = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("condition"), F.when(n % 9 > 0, F.col("user_id") * 10).alias("p"), F.when(n % 8 > 0, F.col("user_id") * 3).alias("c"), F.col("value").alias("latency"), F.when(n % 4 > 0, "completed").otherwise("failed").alias("status")
    )
    return rows.groupBy("condition").agg(*rates.usage("p", "c", "latency", "status", 0.25, 1.5)).withColumn("cost", F.round("cost", 6))


@query("latency_percentiles", "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, count(*) AS n FROM events GROUP BY 1")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest rank."""
    rank = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY value)")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(rank(0.5).alias("p50"), rank(0.95).alias("p95"), F.count("*").alias("n"))


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select((n % 3).alias("seed"), (F.col("o_custkey") % 40).alias("case_id"), F.col("o_orderpriority").alias("arm"), (F.col("o_orderstatus") == "F").cast("int").alias("good"))


SEEDS = "z AS (SELECT o_orderkey % 3 AS seed, o_custkey % 40 AS case_id, o_orderpriority AS arm, CAST(o_orderstatus = 'F' AS INTEGER) AS good FROM orders)"


@query("seed_mean", f"WITH {SEEDS}, c AS (SELECT arm, case_id, avg(good) AS m FROM z GROUP BY ALL) SELECT arm, round(avg(m), 6) AS value, count(*) AS cases FROM c GROUP BY arm")
def seed_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G22."""
    return classes.seed_mean(seeds(spark, sf_dir), ["arm"], "case_id", "good").withColumn("value", F.round("value", 6))


@query("stratum_rate", f"""WITH {SEEDS}, c AS (SELECT arm, case_id, count(*) FILTER (seed = 0) AS inside, count(*) FILTER (seed = 0 AND good = 1) AS good FROM z GROUP BY ALL)
    SELECT arm, round(CASE WHEN sum(inside) > 0 THEN sum(good) FILTER (inside > 0) / sum(inside) FILTER (inside > 0)::DOUBLE END, 6) AS value, count(*) FILTER (inside > 0) AS cases FROM c GROUP BY arm""")
def stratum_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G23."""
    per = seeds(spark, sf_dir).groupBy("arm", "case_id").agg(F.count_if(F.col("seed") == 0).alias("inside"), F.count_if((F.col("seed") == 0) & (F.col("good") == 1)).alias("good"))
    return classes.stratum_rate(per, ["arm"], "inside", "good").withColumn("value", F.round("value", 6))


@query("reading", f"""WITH {SEEDS}, c AS (SELECT arm, case_id, avg(good) FILTER (seed = 0) - avg(good) FILTER (seed = 1) AS d FROM z GROUP BY ALL),
    a AS (SELECT arm, count(*) FILTER (d <> 0) AS discordant, quantile_disc(d, 0.025) AS lo, quantile_disc(d, 0.975) AS hi FROM c GROUP BY arm)
    SELECT arm, discordant, CASE WHEN discordant < 10 THEN 'inconclusive' WHEN lo > 0 THEN 'gain' WHEN hi < 0 THEN 'loss' ELSE 'inconclusive' END AS reading FROM a""")
def reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G24."""
    per = seeds(spark, sf_dir).groupBy("arm", "case_id").agg((F.avg(F.when(F.col("seed") == 0, F.col("good"))) - F.avg(F.when(F.col("seed") == 1, F.col("good")))).alias("d"))
    rank = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY d)")
    a = per.groupBy("arm").agg(F.count_if(F.col("d") != 0).alias("discordant"), rank(0.025).alias("lo"), rank(0.975).alias("hi"))
    return a.select("arm", "discordant", rates.reading(F.col("lo"), F.col("hi"), F.col("discordant")).alias("reading"))


@query("move_range", f"""WITH {SEEDS}, c AS (SELECT arm, seed, count(*) FILTER (good = 1) AS moves FROM z GROUP BY ALL) SELECT arm, min(moves) AS least_moves, max(moves) AS most_moves, count(*) AS seeds FROM c GROUP BY arm""")
def move_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G31."""
    return classes.spread(seeds(spark, sf_dir).groupBy("arm", "seed").agg(F.count_if(F.col("good") == 1).alias("moves")), ["arm"], "moves")


@query("class_counts", f"WITH {O} SELECT outcome, count(*) AS n, min(item_id) AS first_item FROM o GROUP BY 1")
def class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G32."""
    return classes.class_counts(outcomes(spark, sf_dir), "outcome", "item_id")


@query("tallies", f"WITH {O} SELECT 'condition' AS what, condition AS value, count(*) AS n FROM o GROUP BY 2 UNION ALL SELECT 'outcome', outcome, count(*) FROM o GROUP BY 2 UNION ALL SELECT 'gold_status', gold_status, count(*) FROM o GROUP BY 2")
def tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G34."""
    return classes.tallies(outcomes(spark, sf_dir), ["condition", "outcome", "gold_status"])


@query("judge_table", f"""WITH {O} SELECT condition, outcome, count(*) FILTER (item_id % 3 = 0) AS correct, count(*) FILTER (item_id % 3 = 1) AS wrong, count(*) FILTER (item_id % 3 = 2) AS unsure FROM o GROUP BY GROUPING SETS ((condition, outcome), (condition))""")
def judge_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G21."""
    rows = outcomes(spark, sf_dir).withColumn("rating", F.element_at(F.array(F.lit("correct"), F.lit("wrong"), F.lit("unsure")), (F.col("item_id") % 3 + 1).cast("int")))
    return classes.cross_tab(rows, ["condition"], "outcome", "rating", ["correct", "wrong", "unsure"])


@query("judge_cuts", f"""WITH {O}, x AS (SELECT outcome, item_id % 3 AS rating, CASE WHEN condition = 'C' || (item_id % 5) THEN 'self' ELSE 'others' END AS cut FROM o), y AS (SELECT * FROM x UNION ALL SELECT outcome, rating, 'run' FROM x)
    SELECT cut, outcome, count(*) FILTER (rating = 0) AS correct, count(*) FILTER (rating = 1) AS wrong, count(*) FILTER (rating = 2) AS unsure FROM y GROUP BY GROUPING SETS ((cut, outcome), (cut))""")
def judge_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings of a run, of the judge's own answers and of others'."""
    i = F.col("item_id")
    rows = outcomes(spark, sf_dir).withColumn("rating", F.element_at(F.array(F.lit("correct"), F.lit("wrong"), F.lit("unsure")), (i % 3 + 1).cast("int"))).withColumn("judge", F.concat(F.lit("C"), (i % 5).cast("string")))
    return classes.cross_tab(classes.judge_cuts(rows, "judge", "condition"), ["cut"], "outcome", "rating", ["correct", "wrong", "unsure"])
