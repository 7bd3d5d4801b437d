"""Queries of predicates, packet sets, verdicts, traces, mutants and cards."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packsieve.operators import audits, cards, columns, filter_text, matching, mutants, predicates
from packsieve.operators.predicates import Both, Either, Leaf, Neither, Tree
from packsieve.plans.frames import DOCUMENTS, DOCUMENTS_SQL, EVENTS, EVENTS_SQL, document_frames, event_frames, sql, table

QUERIES, SQL = {}, {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            SQL[name] = oracle
        return f

    return add


# One query for each operator, for each way of joining them, over fields that may be absent.
TREES: dict[str, Tree] = {
    "exists": Leaf("doc.quality", "exists"), "eq": Leaf("doc.quality", "eq", 1), "ne": Leaf("doc.quality", "ne", 1), "lt": Leaf("doc.chars", "lt", 500),
    "le": Leaf("doc.toxic", "le", 0), "gt": Leaf("doc.chars", "gt", 2000), "ge": Leaf("doc.toxic", "ge", 1), "contains": Leaf("doc.text", "contains", "the "),
    "in": Leaf("doc.lang", "in", ("fr", "de")), "protocol": Leaf("doc.labelled", "exists"), "many_eq": Leaf("doc.marks", "eq", 0), "many_ne": Leaf("doc.marks", "ne", 0),
    "many_in": Leaf("doc.marks", "in", (1, 7)), "all": Both((Leaf("doc.quality", "eq", 1), Leaf("doc.lang", "eq", "en"))),
    "any": Either((Leaf("doc.toxic", "eq", 1), Leaf("doc.chars", "lt", 300))), "not": Neither(Leaf("doc.quality", "eq", 1)),
    "nested": Both((Neither(Either((Leaf("doc.quality", "eq", 0), Leaf("doc.toxic", "eq", 1)))), Either((Leaf("doc.lang", "ne", "en"), Neither(Leaf("doc.chars", "gt", 1000)))))),
}


def _selects(tree: Tree):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = document_frames(spark, sf_dir)
        if (push := columns.pushable(tree, DOCUMENTS)) is not None:
            rows = rows.where(push)
        return rows.where(columns.column(tree, DOCUMENTS)).select("frame", "probe_id")

    return run


for _name, _tree in TREES.items():
    query(f"pred_{_name}", f"WITH {DOCUMENTS_SQL} SELECT frame, probe_id FROM frames WHERE {sql(_tree, DOCUMENTS)}")(_selects(_tree))

SUBNET = Both((Leaf("event.addr", "in_subnet", "10.8.0.7/13"), Neither(Leaf("event.addr", "in_subnet", "10.8.0.0/14"))))


@query("pred_in_subnet", f"WITH {EVENTS_SQL} SELECT frame, addr FROM frames WHERE {sql(SUBNET, EVENTS)}")
def pred_in_subnet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_frames(spark, sf_dir).where(columns.pushable(SUBNET, EVENTS)).where(columns.column(SUBNET, EVENTS)).select("frame", "addr")


GOLD = Both((Leaf("event.user", "lt", 50), Either((Leaf("event.k", "ge", 40), Neither(Leaf("event.large", "gt", 60.0))))))
CANDIDATES: dict[str, Tree] = {
    "same": Both((Either((Neither(Leaf("event.large", "gt", 60.0)), Leaf("event.k", "ge", 40))), Leaf("event.user", "lt", 50))),
    "bound": Both((Leaf("event.user", "le", 50), Either((Leaf("event.k", "ge", 40), Neither(Leaf("event.large", "gt", 60.0)))))),
    "no_absent": Both((Leaf("event.user", "lt", 50), Either((Leaf("event.k", "ge", 40), Leaf("event.large", "le", 60.0))))),
    "wide": Leaf("event.user", "lt", 50),
    "none": Leaf("event.user", "lt", 0),
    "either_side": Both((Leaf("event.pair", "lt", 50), Either((Leaf("event.k", "ge", 40), Neither(Leaf("event.large", "gt", 60.0)))))),
}
LABEL = "user_id < 50 AND (k >= 40 OR NOT coalesce(large > 60, FALSE))"
_counts_sql = " UNION ALL ".join(
    f"SELECT probe_id, '{c}' AS candidate, count(*) FILTER ({LABEL}) AS n_expected, count(*) FILTER ({sql(t, EVENTS)}) AS n_candidate, count(*) FILTER (({LABEL}) AND {sql(t, EVENTS)}) AS n_both FROM frames GROUP BY probe_id"
    for c, t in CANDIDATES.items()
)
METRICS_SQL = f"""
    {EVENTS_SQL}, counts AS ({_counts_sql}),
    pr AS (SELECT *, n_expected - n_both AS reference_only, n_candidate - n_both AS candidate_only,
        CASE WHEN n_candidate > 0 THEN n_both / n_candidate::DOUBLE WHEN n_expected = 0 THEN 1.0 ELSE 0.0 END AS precision,
        CASE WHEN n_expected > 0 THEN n_both / n_expected::DOUBLE WHEN n_candidate = 0 THEN 1.0 ELSE 0.0 END AS recall FROM counts),
    metrics AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1,
        CASE WHEN n_expected + n_candidate - n_both > 0 THEN n_both / (n_expected + n_candidate - n_both)::DOUBLE ELSE 1.0 END AS jaccard,
        reference_only = 0 AND candidate_only = 0 AS exact, n_expected = 0 AND n_candidate = 0 AS empty_coincidence FROM pr)"""
_RATES = ("precision", "recall", "f1", "jaccard")


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.with_metrics(matching.counts(event_frames(spark, sf_dir), CANDIDATES, F.expr(LABEL), EVENTS))


def _rounded(df: DataFrame, names=_RATES) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


@query("packet_set_metrics", f"""WITH {METRICS_SQL} SELECT probe_id, candidate, n_expected, n_candidate, n_both, reference_only, candidate_only,
    {', '.join(f'round(CAST({m} AS DOUBLE), 6) AS {m}' for m in _RATES)}, exact, empty_coincidence FROM metrics""")
def packet_set_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E1-E4."""
    return _rounded(metrics(spark, sf_dir))


@query("macro_metrics", f"""WITH {METRICS_SQL} SELECT candidate, count(*) AS probes, count(*) FILTER (exact) AS exact_probes,
    {', '.join(f'round(avg({m}), 6) AS macro_{m}' for m in _RATES)}, CAST(quantile_disc(n_candidate, 0.5) AS DOUBLE) AS n_candidate_p50, CAST(quantile_disc(n_candidate, 0.95) AS DOUBLE) AS n_candidate_p95
    FROM metrics GROUP BY candidate""")
def macro_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E5."""
    out = matching.macro(metrics(spark, sf_dir), ["candidate"], "n_candidate")
    return _rounded(out, [f"macro_{m}" for m in _RATES]).withColumns({c: F.col(c).cast("double") for c in ("n_candidate_p50", "n_candidate_p95")})


@query("verdict_by_case", f"""WITH {METRICS_SQL}, per AS (SELECT candidate, bool_and(exact) AS ex, bool_or(n_expected > 0) AS some_e, count(*) AS probes FROM metrics GROUP BY candidate)
    SELECT candidate, probes, CASE WHEN ex AND some_e AND candidate = 'wide' THEN 'shortcut' WHEN ex AND some_e THEN 'strong_exact' ELSE 'silent_wrong' END AS outcome FROM per""")
def verdict_by_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates that ran."""
    yes, none = F.lit(True), F.lit(None).cast("string")
    per = matching.over_probes(metrics(spark, sf_dir), ["candidate"])
    return per.select("candidate", "probes", matching.verdict(yes, yes, yes, yes, none, F.col("candidate") == "wide", F.col("exact_everywhere"), F.col("some_expected")).alias("outcome"))


def _attempts(orders: DataFrame) -> DataFrame:
    """Orders as scored replies: which stage each one fails at is told by its number."""
    n = F.col("o_orderkey") % 11
    return orders.select(
        F.col("o_orderkey").alias("item"), (n != 0).alias("completed"), (n != 1).alias("parsed"), (n != 2).alias("ready"), (n != 3).alias("gold_ready"),
        F.when(n == 4, F.array(F.lit("harness"), F.lit("unknown_field"))).when(n == 5, F.array(F.lit("harness"))).otherwise(F.array().cast("array<string>")).alias("codes"),
        (n == 6).alias("shortcut"), (n.isin(6, 7, 8)).alias("exact"), (n != 8).alias("some"),
    )


@query("verdicts", """WITH a AS (SELECT o_orderkey AS item, o_orderkey % 11 AS n FROM orders)
    SELECT item, CASE n WHEN 0 THEN 'provider_failed' WHEN 1 THEN 'malformed' WHEN 2 THEN 'abstained' WHEN 3 THEN 'false_ready' WHEN 4 THEN 'invalid'
        WHEN 6 THEN 'shortcut' WHEN 7 THEN 'strong_exact' ELSE 'silent_wrong' END AS outcome, CASE WHEN n = 4 THEN 'unknown_field' END AS error_code FROM a""")
def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All eight outcomes."""
    a = _attempts(table(spark, sf_dir, "orders")).withColumn("error_code", F.get(F.filter("codes", lambda c: c.isin("unknown_field", "type_mismatch")), 0))
    c = F.col
    return a.select("item", matching.verdict(c("completed"), c("parsed"), c("ready"), c("gold_ready"), c("error_code"), c("shortcut"), c("exact"), c("some")).alias("outcome"), "error_code")


@query("attribute_error", """WITH a AS (SELECT o_orderkey AS item, o_orderkey % 11 AS n FROM orders)
    SELECT CASE WHEN n = 4 THEN 'unknown_field' END AS code, count(*) AS items FROM a GROUP BY 1""")
def attribute_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of the harness charge nobody."""
    a = _attempts(table(spark, sf_dir, "orders"))
    owned = F.filter("codes", lambda c: c.isin("unknown_field", "type_mismatch", "unsupported_operator"))
    return a.groupBy(F.get(owned, 0).alias("code")).agg(F.count("*").alias("items"))


_P = "l_quantity > 45 AND l_returnflag = 'A'"
_Q = "l_discount >= 0.05 AND l_quantity > 40"


@query("set_diff_frames", f"""WITH a AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE {_P}), b AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE {_Q}),
    both_ AS (SELECT * FROM a INTERSECT SELECT * FROM b)
    SELECT l_orderkey, 'both' AS side FROM both_ UNION ALL SELECT l_orderkey, 'reference_only' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
    UNION ALL SELECT l_orderkey, 'candidate_only' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def set_diff_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E2, U1-U4."""
    rows = table(spark, sf_dir, "lineitem")
    return matching.difference(rows.where(_P), rows.where(_Q), ["l_orderkey"])


_leaf_rows = " UNION ALL ".join(
    f"SELECT frame, probe_id, '{'.'.join(map(str, p)) or 'root'}' AS path, '{x.field} {x.op}' AS leaf, {sql(x, EVENTS)} AS matched FROM wrong" for p, x in predicates.leaves(CANDIDATES["bound"])
)


@query("predicate_trace", f"WITH {EVENTS_SQL}, wrong AS (SELECT * FROM frames WHERE ({LABEL}) <> {sql(CANDIDATES['bound'], EVENTS)}), t AS ({_leaf_rows}) SELECT frame, probe_id, path, leaf, matched FROM t")
def predicate_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves of a candidate on the frames where it is wrong."""
    tree = CANDIDATES["bound"]
    return matching.leaf_matches(event_frames(spark, sf_dir), tree, EVENTS, F.expr(LABEL) != columns.column(tree, EVENTS))


_BOUND = CANDIDATES["bound"]
_PLANTED = predicates.rebuilt(_BOUND, [Neither(p) if i == 0 and isinstance(p, Leaf) else p for i, p in enumerate(predicates.children(_BOUND))]) if predicates.children(_BOUND) else Neither(_BOUND)


@query("trace_recomposed", f"WITH {EVENTS_SQL} SELECT frame, probe_id FROM frames WHERE frame % 97 = 0 AND ({sql(_PLANTED, EVENTS)}) <> ({sql(_BOUND, EVENTS)})")
def trace_recomposed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames on which a tree composed of its recorded leaves differs from the tree: those whose first leaf was recorded wrong, where it counts."""
    tree = CANDIDATES["bound"]
    rows = event_frames(spark, sf_dir).withColumns({f"leaf_{i}": columns.column(x, EVENTS) for i, (_, x) in enumerate(predicates.leaves(tree))})
    rows = rows.withColumn("leaf_0", F.when(F.col("frame") % 97 == 0, ~F.col("leaf_0")).otherwise(F.col("leaf_0")))
    by_path = {".".join(map(str, p)) or "root": F.col(f"leaf_{i}") for i, (p, _) in enumerate(predicates.leaves(tree))}
    return rows.where(matching.recomposed(tree, by_path) != columns.column(tree, EVENTS)).select("frame", "probe_id")


@query("trace_budget", f"""WITH {EVENTS_SQL}, n AS (SELECT probe_id, count(*) FILTER (({LABEL}) <> {sql(CANDIDATES['bound'], EVENTS)}) AS wrong_frames FROM frames GROUP BY 1)
    SELECT probe_id, wrong_frames, wrong_frames <= 1024 AND 3 * wrong_frames <= 65536 AS within FROM n""")
def trace_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E16."""
    tree = CANDIDATES["bound"]
    n = event_frames(spark, sf_dir).groupBy("probe_id").agg(F.count_if(F.expr(LABEL) != columns.column(tree, EVENTS)).alias("wrong_frames"))
    paths = F.lit(len(list(predicates.leaves(tree))))
    return n.withColumn("within", matching.within_budget(paths, paths, F.col("wrong_frames")))


@query("packet_set_hash", f"""WITH {EVENTS_SQL} SELECT probe_id, sha256('[' || string_agg('{{"frame":' || frame || ',"probe_id":"' || probe_id || '"}}', ',' ORDER BY frame) || ']') AS set_hash, count(*) AS n
    FROM frames WHERE {sql(GOLD, EVENTS)} GROUP BY probe_id""")
def packet_set_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E13."""
    rows = event_frames(spark, sf_dir).where(columns.column(GOLD, EVENTS)).select("probe_id", "frame", F.col("probe_id").alias("_p"))
    hashed = rows.select("probe_id", "frame").withColumn("group", F.col("probe_id"))
    return matching.set_hash(hashed, ["group"], "frame", "probe_id").withColumnRenamed("group", "probe_id")


@query("replay_diff", """WITH a AS (SELECT o_orderkey, o_orderstatus AS v FROM orders WHERE o_orderkey % 97 <> 0), b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 89 = 0 THEN 'X' ELSE o_orderstatus END AS v FROM orders WHERE o_orderkey % 83 <> 0)
    SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, a.v AS recorded_o_orderstatus, b.v AS replayed_o_orderstatus,
        CASE WHEN b.o_orderkey IS NULL THEN 'missing' WHEN a.o_orderkey IS NULL THEN 'added' ELSE 'changed' END AS status
    FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey WHERE a.v IS DISTINCT FROM b.v""")
def replay_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E17, J2, K3."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    again = o.where("o_orderkey % 83 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 89 == 0, "X").otherwise(F.col("o_orderstatus")))
    return matching.replay(o.where("o_orderkey % 97 <> 0"), again, ["o_orderkey"], ["o_orderstatus"])


@query("match_stability", f"WITH {EVENTS_SQL} SELECT probe_id, frame, 'bound' AS candidate, 'missing' AS status FROM frames WHERE {sql(CANDIDATES['bound'], EVENTS)} AND frame % 50 = 0")
def match_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate run twice, the second time over frames dealt anew and in reverse order: the only differences are planted ones."""
    frames = event_frames(spark, sf_dir)
    first = matching.matches(frames, CANDIDATES, EVENTS)
    second = matching.matches(frames.repartition("frame"), dict(reversed(CANDIDATES.items())), EVENTS).where("candidate <> 'bound' or frame % 50 <> 0")
    return audits.unstable(first, second, ["probe_id", "frame", "candidate"])


@query("resumed_matches", f"""WITH {EVENTS_SQL}, b AS (SELECT probe_id, 'bound' AS candidate FROM (SELECT DISTINCT probe_id FROM frames)), m AS (SELECT probe_id, count(*) AS n FROM frames WHERE {sql(CANDIDATES['bound'], EVENTS)} GROUP BY 1),
    w AS (SELECT probe_id, count(*) AS n FROM frames WHERE {sql(CANDIDATES['wide'], EVENTS)} GROUP BY 1)
    SELECT probe_id, candidate, coalesce(m.n, 0) AS n, probe_id IN ('click', 'view') AND NOT (probe_id = 'view' AND coalesce(m.n, 0) > 0) AS kept FROM b LEFT JOIN m USING (probe_id)
    UNION ALL SELECT probe_id, 'wide', coalesce(w.n, 0), probe_id IN ('click', 'view') FROM b LEFT JOIN w USING (probe_id)""")
def resumed_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two candidates on two probes are executed, then one of these batches loses a row; taken up again, that one and the missing ones are executed, and all hold."""
    from packsieve.operators.ledger import Ledger
    from packsieve.sources import shared

    book, frames = Ledger(spark, shared.folder(spark, "ledger")), event_frames(spark, sf_dir)
    trees = {c: CANDIDATES[c] for c in ("bound", "wide")}
    probes = frames.select("probe_id").distinct()
    half = probes.where("probe_id in ('click', 'view')").withColumn("candidate", F.explode(F.array(F.lit("bound"), F.lit("wide"))))
    book.execute(frames, trees, EVENTS, probes, half)
    first = book.valid().select("candidate", "probe_id", F.col("run").alias("_first"))
    book.spoil("bound", "view")
    book.execute(frames, trees, EVENTS, probes)
    return book.valid().join(first, ["candidate", "probe_id"], "left").select("probe_id", "candidate", "n", F.coalesce(F.col("run") == F.col("_first"), F.lit(False)).alias("kept"))


@query("prefix_verdict", f"""WITH {EVENTS_SQL}, per AS (SELECT probe_id, count(*) FILTER ({LABEL} AND frame <= 2000) AS e1, count(*) FILTER (({LABEL}) <> hit AND frame <= 2000) AS w1,
        count(*) FILTER ({LABEL}) AS e2, count(*) FILTER (({LABEL}) <> hit) AS w2, count(*) FILTER (({LABEL}) <> hit AND frame > 2000) AS later FROM (SELECT *, {sql(CANDIDATES['bound'], EVENTS)} AS hit FROM frames) GROUP BY 1)
    SELECT CASE WHEN sum(e1) = 0 THEN 'unscorable' WHEN sum(w1) = 0 THEN 'strong_exact' ELSE 'silent_wrong' END AS v1,
        CASE WHEN sum(w2) = 0 AND sum(e2) > 0 THEN 'strong_exact' ELSE 'silent_wrong' END AS v2, CAST(sum(later) AS BIGINT) AS turning_frames FROM per""")
def prefix_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E18."""
    return matching.prefix_verdicts(event_frames(spark, sf_dir), F.expr(LABEL), columns.column(CANDIDATES["bound"], EVENTS), F.lit(2000))


# Mutants of the gold predicate, all in one scan.
SLIPS = mutants.Slips(swaps={"event.user": ("event.pair", "event.k"), "event.k": ("event.user",)}, ports={}, numbers={}, flag_bits={}, codes={})
MUTANTS = mutants.mutants(Both((*GOLD.parts, Leaf("event.addr", "in_subnet", "10.0.0.0/12"))), SLIPS)
GOLD_SUBNET = Both((*GOLD.parts, Leaf("event.addr", "in_subnet", "10.0.0.0/12")))
_DISTINCT = {filter_text.text(m.tree, EVENTS): m for m in reversed(MUTANTS)}
_GOLD_SQL = f"({LABEL}) AND addr BETWEEN 167772160 AND 168820735"
_kill_sql = " UNION ALL ".join(
    f"SELECT '{m.edit}' AS mutant, '{m.category}' AS category, probe_id, bool_or(({_GOLD_SQL}) <> {sql(m.tree, EVENTS)}) AS killed FROM frames GROUP BY probe_id" for m in _DISTINCT.values()
)


def kills(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = {m.edit: columns.column(m.tree, EVENTS) for m in _DISTINCT.values()}
    category = F.create_map(*[F.lit(x) for m in _DISTINCT.values() for x in (m.edit, m.category)])
    found = matching.union([
        audits.kill_matrix(event_frames(spark, sf_dir), F.expr(_GOLD_SQL), dict(batch), "probe_id") for batch in matching.batches(list(hits.items()))
    ])
    return found.withColumn("category", F.element_at(category, F.col("mutant")))


@query("mutant_kill_matrix", f"WITH {EVENTS_SQL}, k AS ({_kill_sql}) SELECT probe_id, mutant, killed, category FROM k")
def mutant_kill_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mutants with equal text are run once."""
    return kills(spark, sf_dir)


@query("mutant_survivors", f"""WITH {EVENTS_SQL}, k AS ({_kill_sql}), s AS (SELECT mutant, category FROM k GROUP BY ALL HAVING NOT bool_or(killed))
    SELECT category, count(*) AS n, count(*) FILTER (mutant LIKE '1.%') AS waived, count(*) FILTER (mutant NOT LIKE '1.%') AS unwaived FROM s GROUP BY CUBE (category)""")
def mutant_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Survivors by category with totals; those below the second child are waived."""
    found = audits.survivors(kills(spark, sf_dir), ["mutant", "category"])
    waivers = found.where(F.col("mutant").startswith("1."))
    open_, _ = audits.waived(found, waivers, ["mutant"])
    marked = found.join(open_.select("mutant", F.lit(False).alias("_w")), "mutant", "left").withColumn("waived", F.coalesce("_w", F.lit(True)))
    return audits.mutation_census(marked, ["category"])


@query("label_by_recipe", """SELECT 'big' AS case_id, l_orderkey, l_linenumber FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_type IN ('ECONOMY', 'SMALL')
    UNION ALL SELECT 'small' AS case_id, l_orderkey, l_linenumber FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_type = 'SMALL'""")
def label_by_recipe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels by membership of a recipe (a part's type), never by a filter."""
    from packsieve.sources.captures import labels

    frames = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("recipe")), "l_partkey")
    cases = spark.createDataFrame([("big", "ECONOMY"), ("big", "SMALL"), ("small", "SMALL")], "case_id string, recipe string")
    return labels(frames, cases, keys=["l_orderkey", "l_linenumber"])


_WRONG = f"({LABEL}) <> {sql(CANDIDATES['no_absent'], EVENTS)}"


@query("counterexample_card", f"""WITH {EVENTS_SQL}, w AS (SELECT probe_id, frame, user_id, k, CASE WHEN {LABEL} THEN 'missed' ELSE 'wrong' END AS side FROM frames WHERE {_WRONG}),
    t AS (SELECT *, row_number() OVER (PARTITION BY probe_id, side ORDER BY frame) AS turn FROM w),
    r AS (SELECT *, row_number() OVER (PARTITION BY probe_id, side, user_id ORDER BY turn) AS rep FROM t),
    p AS (SELECT *, CAST(row_number() OVER (PARTITION BY probe_id ORDER BY turn, side) AS INTEGER) AS position FROM r WHERE rep = 1)
    SELECT probe_id, frame, user_id, k, side, position FROM p WHERE position <= 3""")
def counterexample_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W4."""
    rows = event_frames(spark, sf_dir)
    hit, label = columns.column(CANDIDATES["no_absent"], EVENTS), F.expr(LABEL)
    wrong = rows.where(label != hit).select("probe_id", "frame", "user_id", "k", F.when(label, "missed").otherwise("wrong").alias("side"))
    return cards.chosen(wrong, ["probe_id"], ["user_id"])


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates against gold on events: read from JSON, compiled, matched in one scan, with a verdict for each probe."""
    trees = {n: predicates.from_json(json.dumps(json.loads(predicates.to_json(t)))) for n, t in CANDIDATES.items()}
    frames = event_frames(spark, sf_dir)
    gold = columns.column(predicates.from_json(predicates.to_json(GOLD)), EVENTS)
    out = matching.with_metrics(matching.counts(frames, trees, gold, EVENTS))
    return out.withColumn("verdict", F.when(F.col("exact") & ~F.col("empty_coincidence"), "strong_exact").otherwise("silent_wrong"))
