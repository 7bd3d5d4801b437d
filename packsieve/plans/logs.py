"""Queries of run logs, windows, bills and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packsieve.operators import audits, matching, prompts, rates, retrieval, runs
from packsieve.plans.frames import dealt, table
from packsieve.sources import catalog, records, shared

QUERIES, SQL = {}, {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            SQL[name] = oracle
        return f

    return add


@query("last_attempt_state", """WITH r AS (SELECT user_id, event_id, event_type, value, count(*) OVER (PARTITION BY user_id) AS attempts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
    SELECT user_id, attempts, event_id, event_type, CASE WHEN event_type = 'purchase' THEN 'settled' WHEN event_type = 'error' AND attempts < 200 THEN 'pending' ELSE 'failed' END AS state,
        CAST(ceil(round(value * 100) * 10000) AS BIGINT) AS charged FROM r WHERE rn = 1""")
def last_attempt_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W5, F23."""
    last = runs.last_attempts(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value"), ["user_id"], ["ts", "event_id"])
    status = F.when(F.col("event_type") == "purchase", "completed").otherwise(F.col("event_type"))
    cost = F.round(F.col("value") * 100) / 100
    micro = F.ceil(F.round(cost * 100) * 10000).cast("long")
    return last.select("user_id", "attempts", "event_id", "event_type", runs.state(status, F.col("event_type") == "error", F.col("attempts"), 200).alias("state"), micro.alias("charged"))


@query("charges", """SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey * 5 WHEN o_orderkey % 3 = 1 THEN o_custkey * 2 + o_orderkey * 4 ELSE 1000 END AS BIGINT) AS charged FROM orders""")
def charges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """reported cost, else tokens at the highest prices, else the ceiling."""
    n = F.col("o_orderkey")
    cost, tokens = F.when(n % 3 == 0, n * 5 / 1e6), lambda c: F.when(n % 3 == 1, c)
    return table(spark, sf_dir, "orders").select("o_orderkey", runs.charge(F.when(cost.isNotNull(), F.round(cost * 1e6) / 1e6), tokens(F.col("o_custkey")), tokens(n), 2.0, 4.0, F.lit(1000.0)).alias("charged"))


@query("cost_rollup", "SELECT l_returnflag AS resource, CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DECIMAL(28, 2)) AS cost FROM lineitem GROUP BY ROLLUP (l_returnflag)")
def cost_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G25."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("resource"), F.col("l_extendedprice").cast("decimal(18,2)").alias("cost"))
    return runs.bill(rows, "resource", "cost")


@query("interval_join", """WITH h AS (SELECT DISTINCT date_trunc('hour', ts) AS lo FROM events WHERE event_type = 'purchase')
    SELECT event_id, lo FROM events JOIN h ON ts >= lo AND ts + INTERVAL 10 MINUTE < lo + INTERVAL 1 HOUR""")
def interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of ten minutes inside hours that were billed."""
    e = table(spark, sf_dir, "events")
    hours = e.where("event_type = 'purchase'").select(F.date_trunc("hour", "ts").alias("lo")).distinct().withColumn("hi", F.expr("lo + interval 1 hour"))
    spans = e.select("event_id", "ts", F.expr("ts + interval 10 minutes").alias("finish"))
    return runs.in_billed_hours(spans, hours.select(F.col("lo").cast("timestamp_ntz").alias("lo"), F.col("hi").cast("timestamp_ntz").alias("hi")), "ts", "finish").select("event_id", F.col("lo").cast("timestamp_ntz").alias("lo"))


@query("mode_endpoint", """WITH c AS (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, user_id) AS rn FROM c) SELECT event_type, user_id, n FROM r WHERE rn = 1""")
def mode_endpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G35."""
    return runs.most_frequent(table(spark, sf_dir, "events"), ["event_type"], "user_id")


@query("direction", "SELECT event_id, CASE WHEN user_id = 7 THEN 'out' WHEN event_id % 100 = 7 THEN 'in' ELSE 'other' END AS direction FROM events")
def direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F22."""
    return table(spark, sf_dir, "events").select("event_id", runs.direction(F.col("user_id"), F.col("event_id") % 100, F.lit(7)).alias("direction"))


@query("slot_winner", """WITH c AS (SELECT s_nationkey AS slot, s_suppkey AS rank, s_name AS name, CAST(s_acctbal / 1000 AS INTEGER) AS n FROM supplier), b AS (SELECT *, max(n) OVER (PARTITION BY slot) AS best FROM c)
    SELECT slot, arg_min(name, rank) AS name, arg_min(n, rank) AS n FROM b WHERE best - n <= 4 GROUP BY slot""")
def slot_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W6."""
    c = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("slot"), F.col("s_suppkey").alias("rank"), F.col("s_name").alias("name"), F.round(F.col("s_acctbal") / 1000).cast("int").alias("n"))
    return runs.slot_winner(c, "slot", "n", "rank", "name")


@query("reel_pick", """SELECT p_partkey, p_name, p_size FROM part WHERE p_type = (SELECT CASE WHEN count(*) FILTER (p_type = 'PROMO') > 0 THEN 'PROMO' WHEN count(*) FILTER (p_type = 'SMALL') > 0 THEN 'SMALL' ELSE 'ECONOMY' END FROM part) ORDER BY p_size, p_partkey LIMIT 1""")
def reel_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first condition in order that has items, then the fewest frames, then the smallest number."""
    p = table(spark, sf_dir, "part").withColumn("pri", F.expr("array_position(array('PROMO', 'SMALL', 'ECONOMY'), p_type)")).where("pri > 0")
    return runs.first_in_order(p, [], [F.col("pri"), F.col("p_size"), F.col("p_partkey")], ["p_partkey", "p_name", "p_size"])


@query("highlight", """WITH e AS (SELECT user_id, event_id, event_type, CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'error' THEN 2 END AS pri FROM events)
    SELECT user_id, arg_min(event_id, pri * 100000000 + event_id) AS event_id, arg_min(event_type, pri * 100000000 + event_id) AS event_type FROM e WHERE pri IS NOT NULL GROUP BY user_id""")
def highlight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W8."""
    e = table(spark, sf_dir, "events").withColumn("pri", F.expr("array_position(array('click', 'view', 'error'), event_type)")).where("pri > 0")
    return runs.first_in_order(e, ["user_id"], [F.col("pri"), F.col("event_id")], ["event_id", "event_type"])


@query("distinct_truncated", """SELECT lang, array_to_string(list_sort(list(DISTINCT source))[1:8], ',') AS listed, count(DISTINCT source) AS "distinct" FROM documents GROUP BY lang""")
def distinct_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G28."""
    return runs.listed(table(spark, sf_dir, "documents"), ["lang"], "source").withColumn("listed", F.array_join("listed", ","))


@query("distinct_many", """SELECT o_orderstatus, array_to_string(list_sort(list(DISTINCT o_custkey * 1000003 + o_orderkey))[1:8], ',') AS listed, count(DISTINCT o_custkey * 1000003 + o_orderkey) AS "distinct" FROM orders GROUP BY 1""")
def distinct_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys with as many different values as rows."""
    rows = table(spark, sf_dir, "orders").select("o_orderstatus", (F.col("o_custkey") * 1000003 + F.col("o_orderkey")).alias("v"))
    return runs.listed(rows, ["o_orderstatus"], "v").withColumn("listed", F.array_join(F.transform("listed", lambda v: v.cast("string")), ","))


@query("thinking_state", """SELECT user_id % 50 AS run, CASE WHEN bool_or(event_type = 'error' AND value > 120) THEN 'not_honoured' WHEN count(*) FILTER (value > 150) > 0 THEN 'honoured' ELSE 'uncontrolled' END AS state FROM events GROUP BY 1""")
def thinking_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G29."""
    v = F.col("value")
    return table(spark, sf_dir, "events").groupBy((F.col("user_id") % 50).alias("run")).agg(runs.thinking((F.col("event_type") == "error") & (v > 120), F.when(v > 150, v)).alias("state"))


@query("spend", """WITH e AS (SELECT user_id % 10 AS run, CAST(round(value * 100) AS BIGINT) AS cents, event_id % 6 = 0 AS missing FROM events)
    SELECT run, CAST(sum(cents) AS BIGINT) AS charged, CAST(sum(cents) FILTER (NOT missing) AS BIGINT) AS reported, CASE WHEN bool_or(missing) THEN 'partly_reported' ELSE 'reported' END AS state FROM e GROUP BY run""")
def spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was charged next to what providers report."""
    missing, cents = F.col("event_id") % 6 == 0, F.round(F.col("value") * 100).cast("long")
    return table(spark, sf_dir, "events").groupBy((F.col("user_id") % 10).alias("run")).agg(
        F.sum(cents).alias("charged"), F.sum(F.when(~missing, cents)).alias("reported"), F.when(F.bool_or(missing), "partly_reported").otherwise("reported").alias("state")
    )


@query("run_gate", """SELECT user_id AS run, count(*) AS requests, count(*) FILTER (event_type <> 'error') AS completed, count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY 1 HAVING count(*) FILTER (event_type <> 'error') >= 50""")
def run_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G37."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.when(F.col("event_type") != "error", "completed").otherwise("failed").alias("status"))
    return runs.gate(e, "run", "status", 50)


@query("run_census", """WITH l AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
    SELECT count(*) FILTER (event_type = 'purchase') AS settled, count(*) FILTER (event_type = 'error') AS pending, count(*) FILTER (event_type NOT IN ('purchase', 'error')) AS failed FROM l WHERE rn = 1""")
def run_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G39, W5."""
    last = runs.last_attempts(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"])
    state = runs.state(F.when(F.col("event_type") == "purchase", "completed"), F.col("event_type") == "error", F.lit(0), 1)
    wide = last.agg(*[F.count_if(state == s).alias(s) for s in ("settled", "pending", "failed")])
    return wide


@query("pass_window", """WITH p AS (SELECT user_id, min(ts) AS a, max(ts) AS b FROM events GROUP BY 1) SELECT user_id, b >= a AND b <= a + INTERVAL 24 HOURS AS within FROM p""")
def pass_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W17."""
    p = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return p.select("user_id", runs.within_window(F.col("a"), F.col("b")).alias("within"))


@query("provider_keys", "SELECT DISTINCT p_brand, regexp_replace(lower(p_brand), '[^0-9a-z]', '', 'g') AS provider FROM part")
def provider_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F20."""
    return table(spark, sf_dir, "part").select("p_brand", runs.provider_key(F.concat("p_brand", F.lit("/model-1"))).alias("provider")).distinct()


@query("key_set_audit", """WITH o AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 50 <> 0), l AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_orderkey % 70 <> 0)
    SELECT coalesce(o.k, l.k) AS k, CASE WHEN l.k IS NULL THEN 'missing' ELSE 'added' END AS status FROM o FULL JOIN l ON o.k = l.k WHERE o.k IS NULL OR l.k IS NULL""")
def key_set_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4, A17, U4."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")).where("k % 50 <> 0")
    return audits.listed_against_found(o, table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k")).where("k % 70 <> 0").distinct(), ["k"], [])


@query("routing_audit", """WITH f AS (SELECT l_orderkey AS k, count(*) AS found FROM lineitem GROUP BY 1) SELECT o_orderkey AS k, coalesce(found, 0) AS found FROM orders LEFT JOIN f ON k = o_orderkey WHERE coalesce(found, 0) <> 1""")
def routing_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that don't lead to exactly one row."""
    wanted = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    return runs.one_match(wanted, table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k")), ["k"]).where("found <> 1")


@query("gold_preflight", """WITH m AS (SELECT c_nationkey AS case_id, c_mktsegment AS probe, count(*) FILTER (c_acctbal > 9500) AS n_expected, count(*) FILTER (c_acctbal > 9500 AND c_custkey % 40 <> 0) AS n_both FROM customer GROUP BY ALL)
    SELECT case_id, bool_and(n_expected = n_both) AS exact, max(n_expected) AS most_expected FROM m GROUP BY 1 HAVING NOT bool_and(n_expected = n_both) OR max(n_expected) = 0""")
def gold_preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E11."""
    label, hit = F.col("c_acctbal") > 9500, (F.col("c_acctbal") > 9500) & (F.col("c_custkey") % 40 != 0)
    m = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("case_id"), "c_mktsegment").agg(F.count_if(label).alias("n_expected"), F.count_if(hit).alias("n_candidate"), F.count_if(label & hit).alias("n_both"))
    return audits.not_exact_gold(matching.with_metrics(m), ["case_id"])


@query("receipt_audit", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 41 = 0")
def receipt_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: stored values that differ from the recomputed ones."""
    stored = table(spark, sf_dir, "orders").withColumn("stored", F.when(F.col("o_orderkey") % 41 == 0, "?").otherwise(F.lower("o_orderstatus")))
    return audits.recomputed(stored, {"stored": F.lower("o_orderstatus")}).select("o_orderkey", "o_orderstatus")


@query("round_audit", """WITH o AS (SELECT o_orderkey AS item_id, o_orderkey * 3 AS pos, o_orderkey % 4 = 3 AND o_orderstatus IN ('O', 'P') AS wanted, o_orderkey % 60 <> 0 AND (o_orderkey % 4 = 3 AND o_orderstatus IN ('O', 'P') AND o_orderkey % 35 <> 0 OR o_orderkey % 77 = 0) AS planned,
        o_orderkey * 3 + CAST(o_orderkey % 26 = 0 AS INTEGER) + CAST(o_orderkey % 27 = 0 AS INTEGER) AS planned_pos FROM orders)
    SELECT item_id, CASE WHEN NOT planned THEN 'missing' WHEN NOT wanted THEN 'added' ELSE 'moved' END AS status FROM o WHERE (wanted OR planned) AND NOT (wanted AND planned AND pos = planned_pos)""")
def round_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A repair plan against what the trigger picks: items missing, added, or at another place."""
    k, status = F.col("o_orderkey"), F.col("o_orderstatus")
    outcome = F.when(status == "O", "silent_wrong").when(status == "P", "invalid").otherwise("strong_exact")
    o = table(spark, sf_dir, "orders").select(k.alias("item_id"), F.concat(F.lit("C"), (k % 4 + 1).cast("string")).alias("condition"), outcome.alias("outcome"), (k * 3).alias("pos"))
    i = F.col("item_id")
    kept = runs.repair_plan(o).where(i % 35 != 0).select("item_id", "pos").unionByName(o.where(i % 77 == 0).select("item_id", "pos")).where(i % 60 != 0).distinct()
    moved = kept.withColumn("pos", F.col("pos") + (i % 26 == 0).cast("int") + (i % 27 == 0).cast("int"))
    return runs.plan_differs(o, moved)


@query("settings_guard", """WITH s AS (SELECT o_orderkey, unnest([{'setting': 'o_orderstatus', 'registered': 'F', 'found': CAST(o_orderstatus AS VARCHAR)}, {'setting': 'o_orderpriority', 'registered': '1-URGENT', 'found': o_orderpriority}]) AS x FROM orders)
    SELECT o_orderkey, x.setting AS setting, x.registered AS registered, x.found AS found FROM s WHERE x.registered IS DISTINCT FROM x.found""")
def settings_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A12."""
    return audits.settings_differ(table(spark, sf_dir, "orders"), {"o_orderstatus": "F", "o_orderpriority": "1-URGENT"}, ["o_orderkey"])


@query("anchor_audit", "SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) <> 1")
def anchor_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors that don't have exactly one row."""
    return audits.exactly_once(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k")), "k")


_SIDES = """o AS (SELECT o_orderkey AS k, md5(CAST(o_custkey AS VARCHAR)) AS d FROM orders), s AS (SELECT 'plan' AS side, k, d FROM o WHERE k % 97 <> 0 UNION ALL SELECT 'plan', k, d FROM o WHERE k % 101 = 0 AND k % 97 <> 0
        UNION ALL SELECT 'evidence', k, CASE WHEN k % 89 = 0 THEN 'other' ELSE d END FROM o WHERE k % 83 <> 0 UNION ALL SELECT 'evidence', -k, d FROM o WHERE k % 79 = 0 UNION ALL SELECT 'export', k, d FROM o WHERE k % 73 <> 0),
    a AS (SELECT k, count(*) FILTER (side = 'plan') AS p, count(*) FILTER (side = 'evidence') AS e, count(*) FILTER (side = 'export') AS x, count(DISTINCT d) AS ds FROM s GROUP BY k)"""


@query("anchor_reconcile", f"""WITH {_SIDES} SELECT k, array_to_string(list_filter([CASE WHEN p = 0 THEN 'plan' END, CASE WHEN e = 0 THEN 'evidence' END, CASE WHEN x = 0 THEN 'export' END], lambda v: v IS NOT NULL), ',') AS missing,
        array_to_string(list_filter([CASE WHEN p > 1 THEN 'plan' END, CASE WHEN e > 1 THEN 'evidence' END, CASE WHEN x > 1 THEN 'export' END], lambda v: v IS NOT NULL), ',') AS repeated, ds > 1 AS differs
    FROM a WHERE p <> 1 OR e <> 1 OR x <> 1 OR ds > 1""")
def anchor_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three manifests of orders, with anchors missing, told twice, added and changed."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.md5(F.col("o_custkey").cast("string").cast("binary")).alias("d"))
    k = F.col("k")
    plan = o.where(k % 97 != 0).unionByName(o.where((k % 101 == 0) & (k % 97 != 0)))
    evidence = o.where(k % 83 != 0).withColumn("d", F.when(k % 89 == 0, "other").otherwise(F.col("d"))).unionByName(o.where(k % 79 == 0).withColumn("k", -k))
    found = audits.reconciled({"plan": plan, "evidence": evidence, "export": o.where(k % 73 != 0)}, "k", "d")
    return found.withColumns({c: F.array_join(c, ",") for c in ("missing", "repeated")})


@query("suite_kills", """WITH k AS (SELECT o_custkey AS case_id, o_orderkey % 3 AS pos, bool_or(o_orderstatus <> 'F') AS killed FROM orders GROUP BY ALL)
    SELECT count(DISTINCT case_id) AS cases, count(DISTINCT case_id) FILTER (killed) AS killed, count(DISTINCT case_id) FILTER (killed AND pos = 0) AS killed_by_first FROM k""")
def suite_kills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Any probe against the first alone."""
    return audits.suite(table(spark, sf_dir, "orders"), "o_custkey", F.col("o_orderstatus") != "F", F.col("o_orderkey") % 3 == 0)


@query("rows_differ", """WITH m AS (SELECT o_custkey AS member, count(DISTINCT o_orderpriority) AS groups FROM orders GROUP BY 1) SELECT member, groups FROM m WHERE groups < (SELECT count(DISTINCT o_orderpriority) FROM orders)""")
def rows_differ(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A11."""
    o = table(spark, sf_dir, "orders").select("o_orderpriority", F.col("o_custkey").alias("member"))
    return audits.same_members(o, "o_orderpriority", "member")


@query("control_pass", """SELECT o_orderkey AS item_id, CASE WHEN o_orderkey % 2 = 0 THEN c_mktsegment ELSE c_mktsegment || '!' END AS answer, CASE WHEN o_orderkey % 2 = 0 THEN 'strong_exact' ELSE 'silent_wrong' END AS outcome FROM orders JOIN customer ON o_custkey = c_custkey""")
def control_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts answered from gold, or from its mutation, and scored."""
    items = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item_id"), F.col("o_custkey").alias("c_custkey"))
    j = items.join(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_custkey")
    answer = F.when(F.col("item_id") % 2 == 0, F.col("c_mktsegment")).otherwise(F.concat("c_mktsegment", F.lit("!")))
    yes, none = F.lit(True), F.lit(None).cast("string")
    return j.select("item_id", answer.alias("answer"), matching.verdict(yes, yes, yes, yes, none, F.lit(False), answer == F.col("c_mktsegment"), yes).alias("outcome"))


@query("admission", "SELECT doc_id, source FROM documents WHERE source <> 'src0' AND md5(text) NOT IN (SELECT md5(text) FROM documents WHERE doc_id % 2 = 0)")
def admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A6."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.md5(F.col("text").cast("binary")).alias("digest"))
    return audits.not_admitted(d, F.col("source") == "src0", d.where("doc_id % 2 = 0").select("digest").distinct(), "digest").select("doc_id", "source")


@query("judge_dedup", "SELECT md5(text) AS k, min(lang) AS lang, count(*) AS rows, count(DISTINCT lang) > 1 AS conflict FROM documents GROUP BY 1")
def judge_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J14."""
    return runs.same_answer(table(spark, sf_dir, "documents").select(F.md5(F.col("text").cast("binary")).alias("k"), "lang"), ["k"], ["lang"])


@query("zip_positions", """WITH a AS (SELECT conv_id, list(role ORDER BY turn) AS x, list(CAST(length(text) AS INTEGER) ORDER BY turn) FILTER (turn > 0) AS y FROM conversations GROUP BY 1),
    g AS (SELECT conv_id, x, y, unnest(range(0, greatest(len(x), coalesce(len(y), 0)))) AS pos FROM a) SELECT conv_id, CAST(pos AS INTEGER) AS pos, x[pos + 1] AS x, y[pos + 1] AS y FROM g""")
def zip_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J11."""
    c = table(spark, sf_dir, "conversations")
    ordered = lambda value, where, name: c.where(where).groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", value.alias("v")))), lambda s: s["v"]).alias(name))
    y = c.select("conv_id").distinct().join(ordered(F.length("text"), "turn > 0", "y"), "conv_id", "left").withColumn("y", F.coalesce("y", F.array().cast("array<int>")))
    return audits.zipped(ordered(F.col("role"), "true", "x"), y, ["conv_id"], "x", "y")


@query("ordered_subsequence", "WITH p AS (SELECT conv_id, turn, length(text) AS n, lag(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations) SELECT conv_id, turn FROM p WHERE b >= n")
def ordered_subsequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J12."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("n"))
    return audits.out_of_order(rows, "turn", "n", ["conv_id"]).select("conv_id", "turn")


@query("set_union_symdiff", """WITH a AS (SELECT l_suppkey, list(DISTINCT l_returnflag) FILTER (l_quantity > 25) AS x, list(DISTINCT l_returnflag) FILTER (l_quantity < 3) AS y FROM lineitem GROUP BY 1)
    SELECT l_suppkey, CAST(len(list_distinct(list_concat(coalesce(x, []), coalesce(y, [])))) AS INTEGER) AS union_size, CAST(len(list_distinct(list_concat(coalesce(x, []), coalesce(y, [])))) - len(list_intersect(coalesce(x, []), coalesce(y, []))) AS INTEGER) AS apart FROM a""")
def set_union_symdiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U3, U6, U7."""
    from packsieve.operators import classes

    a = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.collect_set(F.when(F.col("l_quantity") > 25, F.col("l_returnflag"))).alias("x"), F.collect_set(F.when(F.col("l_quantity") < 3, F.col("l_returnflag"))).alias("y"))
    return a.select("l_suppkey", F.size(F.array_union("x", "y")).alias("union_size"), classes.symmetric_difference(F.col("x"), F.col("y")).alias("apart"))


@query("group_resolution", """SELECT p_name || '.' || p_brand AS name, min(p_type) AS kind, count(*) AS n FROM part GROUP BY 1 HAVING count(*) <= 64 AND count(DISTINCT p_type) = 1 AND bool_and(p_size > 0)""")
def group_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W12."""
    r = table(spark, sf_dir, "part").select(F.concat_ws(".", "p_name", "p_brand").alias("name"), F.col("p_type").alias("kind"), F.col("p_brand").alias("protocol"), F.col("p_name").alias("display"), (F.col("p_size") > 0).alias("valid"))
    n = r.groupBy("name").agg(F.count("*").alias("n"))
    return retrieval.resolved(r).join(n, "name").select("name", "kind", "n")


@query("relative_number", "SELECT user_id, event_id, event_id - first_value(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS relative FROM events")
def relative_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W16."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_id") - F.first("event_id").over(w)).alias("relative"))


@query("inventory", """SELECT 'type' AS what, p_type AS key, count(*) AS n FROM part GROUP BY 2 UNION ALL SELECT 'values', p_brand, count(*) FROM part GROUP BY 2 UNION ALL SELECT 'names', '', count(DISTINCT p_name) FROM part""")
def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G38."""
    from packsieve.sources import catalog

    p = table(spark, sf_dir, "part")
    return catalog.inventory(p.select(F.col("p_name").alias("name"), F.col("p_type").alias("raw"), F.lit("integer").alias("kind")), p.select(F.col("p_brand").alias("name")))


@query("catalog_bind", """WITH u AS (SELECT DISTINCT p_name AS name FROM part UNION SELECT 'no such'), c AS (SELECT p_name AS name, count(DISTINCT p_type) AS kinds FROM part GROUP BY 1)
    SELECT u.name, CASE WHEN kinds IS NULL THEN 'unknown_field' WHEN kinds > 1 THEN 'conflict' END AS code FROM u LEFT JOIN c ON u.name = c.name""")
def catalog_bind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S9, S10."""
    from packsieve.sources import catalog

    p = table(spark, sf_dir, "part")
    used = p.select(F.col("p_name").alias("name")).union(spark.createDataFrame([("no such",)], "name string"))
    return catalog.bind(used, p.select(F.col("p_name").alias("name"), F.col("p_type").alias("kind"), F.col("p_type").alias("raw"), F.col("p_brand").alias("protocol"), F.col("p_name").alias("display"))).select("name", "code")


@query("catalog_records", """WITH d AS (SELECT doc_id, replace(replace(coalesce(text, ''), chr(13), ' '), chr(10), chr(10) || ' ') AS t FROM documents)
    SELECT doc_id, CAST(1 + length(t) - length(replace(t, chr(10), '')) AS INTEGER) AS lines, md5('F' || chr(9) || doc_id || chr(9) || t) AS digest FROM d""")
def catalog_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as a report of many files, in which a record runs on over indented lines, and put together again."""
    path = shared.folder(spark, "report")
    text = F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), "\r", " "), "\n", "\n ")
    dealt(table(spark, sf_dir, "documents")).select(F.concat(F.lit("F\t"), F.col("doc_id").cast("string"), F.lit("\t"), text).alias("value")).write.text(path)
    record = F.col("record")
    return catalog.records(catalog.lines(spark, path)).select(
        F.split_part(record, F.lit("\t"), F.lit(2)).cast("long").alias("doc_id"), (F.regexp_count(record, F.lit("\n")) + 1).cast("int").alias("lines"), F.md5(record.cast("binary")).alias("digest")
    )


@query("run_files", """WITH c AS (SELECT DISTINCT conv_id AS k FROM conversations)
    SELECT 'r' || k % 3 AS run, 'C' || (1 + k % 4) AS condition, 'conv ' || k AS item, CASE WHEN k % 11 = 0 THEN 'missing' WHEN k % 7 = 0 THEN 'added' ELSE 'changed' END AS status FROM c
    WHERE (k % 11 = 0 AND k % 7 <> 0) OR (k % 11 <> 0 AND (k % 7 = 0 OR k % 13 = 0))""")
def run_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written as a run directory, a file each, and compared with a list of their digests: some are missing, some added, some changed."""
    turns = F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))))
    k = F.col("conv_id")
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(turns.alias("value")).select(
        k, F.concat(F.lit("r"), (k % 3).cast("string")).alias("run"), F.concat(F.lit("C"), (1 + k % 4).cast("string")).alias("condition"), F.concat(F.lit("conv "), k.cast("string")).alias("item"), "value"
    )
    path = shared.folder(spark, "run")
    records.write_run(rows.where(k % 11 != 0).withColumn("value", F.when(k % 13 == 0, F.concat("value", F.lit(" "))).otherwise(F.col("value"))), path)
    listed = rows.where(k % 7 != 0).select("run", "condition", "item", F.sha2(F.concat("value", F.lit("\n")).cast("binary"), 256).alias("digest"))
    found = records.run_files(spark, path).select("run", "condition", "item", "digest")
    return audits.listed_against_found(listed, found, ["run", "condition", "item"], ["digest"]).select("run", "condition", "item", "status")


# Benchmark texts as requests, each with up to three parts as its retrieved fields; some recorded digests and contexts are changed or gone.
_PROMPTS = """c AS (SELECT (p_partkey - 1) // 3 AS item_id, string_agg('{"name":' || CAST(to_json(p_name) AS VARCHAR) || '}', ',' ORDER BY p_partkey) AS fields FROM part GROUP BY 1),
    p AS (SELECT b.item_id, 'Answer with one filter.' || chr(10) || '{"context":[' || coalesce(c.fields, '') || ']}' || chr(10) || '{"request":' || coalesce(CAST(to_json(text) AS VARCHAR), 'null') || '}' AS prompt, c.fields IS NOT NULL AS told FROM benchmark b LEFT JOIN c USING (item_id))"""


@query("prompt_rebuild", f"""WITH {_PROMPTS} SELECT item_id, sha256(prompt) AS prompt_sha256, item_id % 5 = 0 OR item_id % 7 = 0 AS differs, NOT (item_id % 11 = 0 AND told) AS as_shown FROM p""")
def prompt_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every prompt built anew, those whose recorded digest is another or missing, and those that don't hold the recorded context."""
    k = F.col("item_id")
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("intent"))
    part = table(spark, sf_dir, "part").select(F.expr("(p_partkey - 1) div 3").alias("item_id"), F.col("p_partkey").alias("rank"), F.col("p_name").alias("name"))
    context = prompts.listed(part, "item_id", "rank", ["name"], "context")
    made = prompts.assembled(items, "Answer with one filter.", context=context)
    recorded = made.where(k % 7 != 0).withColumn("prompt_sha256", F.when(k % 5 == 0, "?").otherwise(F.col("prompt_sha256")))
    other = context.withColumn("context", F.when(k % 11 == 0, F.concat("context", F.lit(" "))).otherwise(F.col("context")))
    wrong = prompts.not_rebuilt(recorded, made).withColumn("differs", F.lit(True))
    hidden = prompts.not_as_shown(made, other).withColumn("as_shown", F.lit(False))
    return made.select("item_id", "prompt_sha256").join(wrong, "item_id", "left").join(hidden, "item_id", "left").select(
        "item_id", "prompt_sha256", F.coalesce("differs", F.lit(False)).alias("differs"), F.coalesce("as_shown", F.lit(True)).alias("as_shown")
    )
