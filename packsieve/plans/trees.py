"""Queries over trees and replies that come as rows, and the gate on training rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packsieve.operators import adequacy, filter_text, leakage, matching, mutants, replies, shortcuts, tree_rows
from packsieve.operators import predicates as P
from packsieve.operators.predicates import Both, Either, Field, Leaf, Neither
from packsieve.operators.tree_rows import document, group, negated, predicate
from packsieve.plans.frames import EVENTS, EVENTS_SQL, dealt, event_frames, sql, table
from packsieve.sources import shared

QUERIES, SQL = {}, {}


def query(name: str, oracle: str):
    def add(f):
        QUERIES[name], SQL[name] = f, oracle
        return f

    return add


# Every part as a tree of one of ten shapes, with its size and its type for values.
def part_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("p_partkey"), F.col("p_partkey") % 16
    user = predicate("event.user", "lt", F.col("p_size").cast("string"))
    kinds = predicate("event.type", "in", F.concat(F.lit('["z","'), F.lower("p_type"), F.lit('"]')))
    none, blob = predicate("event.none", "exists"), predicate("event.blob", "eq", F.lit('"x"'))
    order, wrong = predicate("event.type", "lt", F.lit('"t"')), predicate("event.user", "eq", F.lit("true"))
    made = (
        F.when(n % 8 == 0, user).when(n % 8 == 1, group("all", kinds, user)).when(n % 8 == 2, group("all", user, group("all", kinds, negated(user))))
        .when(n == 3, group("any", negated(none), user)).when(n == 11, group("any", negated(blob), user))
        .when(n == 4, group("all", order, wrong)).when(n == 12, group("all", wrong, order))
        .when(n % 8 == 5, group("all", user)).when(n % 8 == 6, group("all", user, kinds)).otherwise(negated(negated(predicate("event.large", "gt", F.lit("60.0")))))
    )
    return dealt(table(spark, sf_dir, "part")).select(k, document(made).alias("tree"))


_LEAVES = """p AS (SELECT p_partkey, p_partkey % 16 AS n, CAST(p_size AS VARCHAR) AS s, lower(p_type) AS t FROM part),
    leaf(shape, pos, path, field, operator, value) AS (VALUES (0, 0, 'root', 'event.user', 'lt', 'S'), (1, 0, '0', 'event.type', 'in', 'T'), (1, 1, '1', 'event.user', 'lt', 'S'), (2, 0, '0', 'event.user', 'lt', 'S'),
        (2, 1, '1.0', 'event.type', 'in', 'T'), (2, 2, '1.1.0', 'event.user', 'lt', 'S'), (3, 0, '0.0', 'event.none', 'exists', NULL), (3, 1, '1', 'event.user', 'lt', 'S'),
        (11, 0, '0.0', 'event.blob', 'eq', '"x"'), (11, 1, '1', 'event.user', 'lt', 'S'), (4, 0, '0', 'event.type', 'lt', '"t"'), (4, 1, '1', 'event.user', 'eq', 'true'),
        (12, 0, '0', 'event.user', 'eq', 'true'), (12, 1, '1', 'event.type', 'lt', '"t"'), (6, 0, '0', 'event.user', 'lt', 'S'), (6, 1, '1', 'event.type', 'in', 'T'), (7, 0, '0.0', 'event.large', 'gt', '60.0'))"""
_SHAPE = "CASE WHEN n IN (3, 4, 11, 12) THEN n ELSE n % 8 END"


@query("leaf_walk", f"""WITH {_LEAVES} SELECT p_partkey, CAST(pos AS INTEGER) AS pos, path, field, operator, CASE value WHEN 'S' THEN s WHEN 'T' THEN '["z","' || t || '"]' ELSE value END AS value FROM p JOIN leaf ON shape = {_SHAPE}""")
def leaf_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaves of every part's tree."""
    return tree_rows.leaves(part_trees(spark, sf_dir), "p_partkey", "tree")


_CANONICAL = """p AS (SELECT p_partkey, p_partkey % 16 AS n, '{"field":"event.user","kind":"predicate","operator":"lt","value":' || p_size || '}' AS a,
        '{"field":"event.type","kind":"predicate","operator":"in","value":["' || lower(p_type) || '","z"]}' AS b FROM part),
    c AS (SELECT p_partkey, CASE WHEN n % 8 = 0 THEN a WHEN n % 8 IN (1, 6) THEN '{"children":[' || b || ',' || a || '],"kind":"all"}' WHEN n % 8 = 2 THEN '{"children":[{"child":' || a || ',"kind":"not"},' || b || ',' || a || '],"kind":"all"}'
        WHEN n = 3 THEN '{"children":[{"child":{"field":"event.none","kind":"predicate","operator":"exists"},"kind":"not"},' || a || '],"kind":"any"}'
        WHEN n = 11 THEN '{"children":[{"child":{"field":"event.blob","kind":"predicate","operator":"eq","value":"x"},"kind":"not"},' || a || '],"kind":"any"}'
        WHEN n % 8 = 4 THEN '{"children":[{"field":"event.type","kind":"predicate","operator":"lt","value":"t"},{"field":"event.user","kind":"predicate","operator":"eq","value":true}],"kind":"all"}'
        WHEN n % 8 = 7 THEN '{"child":{"child":{"field":"event.large","kind":"predicate","operator":"gt","value":60.0},"kind":"not"},"kind":"not"}' END AS canonical,
        CASE n % 8 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 6 THEN 1 WHEN 4 THEN 1 WHEN 2 THEN 3 ELSE 2 END AS depth FROM p)"""


@query("canonical_dedup", f"WITH {_CANONICAL} SELECT sha256(canonical) AS tree_key, min(p_partkey) AS p_partkey, count(*) AS trees, CAST(min(depth) AS INTEGER) AS depth FROM c WHERE canonical IS NOT NULL GROUP BY canonical")
def canonical_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees that differ in order and nesting alone are kept once."""
    return tree_rows.alike(tree_rows.facts(part_trees(spark, sf_dir), "p_partkey", "tree", EVENTS), "p_partkey")


@query("refused_codes", """SELECT p_partkey, CASE WHEN p_partkey % 16 = 3 THEN 'unknown_field' WHEN p_partkey % 16 = 11 THEN 'unsupported_type' WHEN p_partkey % 16 = 4 THEN 'unsupported_operator' WHEN p_partkey % 16 = 12 THEN 'type_mismatch'
    WHEN p_partkey % 8 = 5 THEN 'malformed' END AS code FROM part""")
def refused_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why the catalog, or the grammar, refuses a part's tree."""
    return tree_rows.facts(part_trees(spark, sf_dir), "p_partkey", "tree", EVENTS).select("p_partkey", "code")


# Replies made from the turns of conversations: one of each kind that the envelope takes or refuses.
_IR = '{"ir_schema_version":"1.0","scope":"packet","expression":{"kind":"predicate","field":"event.user","operator":"lt","value":5}}'
_REPLIES = (
    (None, f'{{"status":"ready","assumptions":[@],"intent_ir":{_IR}}}'), ("malformed", f'{{"status":"ready","intent_ir":{_IR}}} and so on'), ("malformed", f'{{"status":"ready","intent_ir":{_IR},"note":@}}'),
    ("malformed", '{"status":"not_expressible","status":"not_expressible"}'), ("malformed", '{"status":"not_expressible","assumptions":@}'), (None, '{"status":"needs_clarification","clarifying_question":"Which port?","missing_slots":["port"]}'),
    ("malformed", '{"status":"needs_clarification","clarifying_question":"Which port?","missing_slots":["port","port"]}'), ("malformed", '{"status":"needs_clarification","clarifying_question":"Which?","missing_slots":["colour"]}'),
    (None, '{"schema_version":"1.0","status":"not_expressible","assumptions":[@,"none"],"intent_ir":null}'), ("malformed", '{"status":"ready","assumptions":[]}'), ("malformed", '{"status":"not_expressible","assumptions":["#"]}'),
    ("malformed", '{"status":"ready","display_filter":"tcp"}'), ("malformed", f'```json {{"status":"ready","intent_ir":{_IR}}}```'), ("malformed", '{"status":"not_expressible","assumptions":[1]}'), (None, ' {"status" : "needs_clarification", "clarifying_question": @ } '),
    ("malformed", '{"status":"not_expressible"}],[{}'), ("malformed", '{"status":"not_expressible","z":1'), ("malformed", '[{"status":"not_expressible"}]'), (None, '{"status":"not_expressible","clarifying_question":null}'),
)
_OUT = [(x.startswith(" ") or "Which port" in x) and "needs_clarification" or ("not_expressible" if "not_exp" in x else "ready") if c is None else None for c, x in _REPLIES]


def reply_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.pmod(F.col("conv_id") * 7 + F.col("turn"), F.lit(len(_REPLIES)))
    said = F.to_json(F.array(F.coalesce("text", F.lit("-"))))
    shape = F.element_at(F.array(*[F.lit(x) for _, x in _REPLIES]), (n + 1).cast("int"))
    # 40,000 letters of two bytes: under 64 Ki characters, over 64 KiB
    filled = F.replace(F.replace(shape, F.lit("@"), F.substr(said, F.lit(2), F.length(said) - 2)), F.lit("#"), F.repeat(F.lit("é"), 40_000))
    return dealt(table(spark, sf_dir, "conversations")).select("conv_id", "turn", n.alias("n"), F.coalesce("text", F.lit("-")).alias("said"), filled.alias("reply"))


@query("reply_parse", f"""WITH c AS (SELECT conv_id, turn, coalesce(text, '-') AS said, (conv_id * 7 + turn) % {len(_REPLIES)} AS n FROM conversations),
    kind(n, code, status, question, slots, told) AS (VALUES {', '.join(f"({i}, {'NULL' if c is None else repr(c)}, {'NULL' if o is None else repr(o)}, {repr('Which port?') if i == 5 else repr('@') if i == 14 else 'NULL'}, {1 if i == 5 else 0}, {1 if i == 0 else 2 if i == 8 else 0})" for i, ((c, _), o) in enumerate(zip(_REPLIES, _OUT, strict=True)))})
    SELECT conv_id, turn, code, status, CASE WHEN question = '@' THEN said ELSE question END AS question, CAST(CASE WHEN code IS NULL THEN slots END AS INTEGER) AS missing, CAST(CASE WHEN code IS NULL THEN told END AS INTEGER) AS assumptions,
        CASE WHEN code IS NULL AND told > 0 THEN said END AS assumed, CASE WHEN n = 0 THEN '{_IR}' END AS payload FROM c JOIN kind USING (n)""")
def reply_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The envelope of every reply."""
    r = replies.parsed(F.col("reply"), "typed_ir")
    size = lambda name: F.when(F.col(f"r.{name}").isNotNull(), F.size(f"r.{name}"))
    return reply_texts(spark, sf_dir).select("conv_id", "turn", r.alias("r")).select(
        "conv_id", "turn", "r.code", "r.status", "r.question", size("missing").alias("missing"), size("assumptions").alias("assumptions"), F.get("r.assumptions", 0).alias("assumed"), "r.payload"
    )


# Frame sets that are equal though their trees differ, and sets that are not.
TRAINED = {f"lt_{i}": Leaf("event.user", "lt", i) for i in range(0, 40)} | {f"pair_{i}": Leaf("event.pair", "lt", i) for i in (0, 3, 7)}
GOLDEN = {f"le_{i}": Leaf("event.user", "le", i) for i in (0, 8, 20, 38, 77)} | {"nothing": Leaf("event.user", "lt", -1), "large": Leaf("event.large", "gt", 60.0)}
_chosen = lambda trees: " UNION ALL ".join(f"SELECT '{c}' AS c, probe_id, frame FROM frames WHERE {sql(t, EVENTS)}" for c, t in trees.items())
_LISTS = f"""{EVENTS_SQL}, a AS (SELECT c, list((probe_id, frame) ORDER BY probe_id, frame) AS l FROM ({_chosen(TRAINED)}) GROUP BY c), b AS (SELECT c, list((probe_id, frame) ORDER BY probe_id, frame) AS l FROM ({_chosen(GOLDEN)}) GROUP BY c)"""


@query("frame_signature_overlap", f"WITH {_LISTS} SELECT a.c AS candidate, b.c AS gold, CAST(len(a.l) AS BIGINT) AS n FROM a JOIN b ON a.l = b.l")
def frame_signature_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: candidates that select what some gold tree selects, on every probe."""
    frames = event_frames(spark, sf_dir)
    gold = matching.matches(frames, GOLDEN, EVENTS).withColumnRenamed("candidate", "gold")
    return matching.same_frames(matching.matches(frames, TRAINED, EVENTS), gold, "candidate", "gold")


# Parts as training rows: a request and a tree; keys, texts and frames of the gold are those of GATE_GOLD and of the benchmark.
GATE_GOLD = {"key": Leaf("event.user", "lt", 20), "frames": Leaf("event.user", "le", 9)}


def training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    value = F.when(k % 41 == 0, F.lit("true")).when(k % 43 == 0, F.lit("1000000")).otherwise((k * 7 % 50).cast("string"))
    frame_no = predicate("event.k", "lt", (41000 + k % 3).cast("string"))
    tree = F.when(k % 5 == 0, group("any", predicate("event.user", "lt", value), frame_no)).otherwise(predicate("event.user", "lt", value))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("_item"), F.col("text").alias("_said"))
    rows = dealt(table(spark, sf_dir, "part")).select(k, document(tree).alias("tree"), "p_name", F.when(k % 3 == 0, k % 30).alias("_item"))
    return rows.join(asked, "_item", "left").select("p_partkey", "tree", F.coalesce("_said", "p_name").alias("request"))


_GATE = f"""{EVENTS_SQL}, p AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 41 = 0 THEN NULL WHEN p_partkey % 43 = 0 THEN 1000000 ELSE p_partkey * 7 % 50 END AS v, p_partkey % 5 = 0 AS wide, p_partkey % 3 AS w,
        coalesce(b.text, p_name) AS request FROM part LEFT JOIN benchmark b ON p_partkey % 3 = 0 AND b.item_id = p_partkey % 30),
    f AS (SELECT *, CASE WHEN v IS NOT NULL THEN v || CASE WHEN wide THEN '/' || w ELSE '' END END AS key FROM p),
    o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY k) AS nth, wide AND NOT regexp_matches(request, '(^|[^0-9A-Za-z_.:/-])' || (41000 + w) || '($|[^0-9A-Za-z_.:/-])') AS hit FROM f),
    g AS (SELECT count(*) AS frames, count(*) FILTER (user_id <= 9) AS gold FROM frames),
    c AS (SELECT key, count(*) FILTER (user_id < v OR wide AND k_ < 41000 + w) AS n, count(*) FILTER ((user_id < v OR wide AND k_ < 41000 + w) <> (user_id <= 9)) AS apart FROM (SELECT DISTINCT key, v, wide, CASE WHEN wide THEN w END AS w FROM f WHERE key IS NOT NULL), (SELECT user_id, k AS k_ FROM frames) GROUP BY key),
    x AS (SELECT o.k, CASE WHEN o.key IS NULL THEN 'compile' WHEN o.key = '20' THEN 'dev_test_key' WHEN nth > 1 THEN 'duplicate_key' WHEN hit THEN 'shortcut'
        WHEN len(regexp_extract_all(lower(request), '[a-z0-9]+')) >= 8 AND request IN (SELECT text FROM benchmark) THEN 'dev_test_text' WHEN c.n = 0 OR c.n = g.frames THEN 'degenerate' WHEN apart = 0 THEN 'dev_test_frames' END AS rule
        FROM g, o LEFT JOIN c ON o.key = c.key)"""


@query("train_gate", f"WITH {_GATE} SELECT rule, count(*) AS n, min(k) AS first_part FROM x GROUP BY rule")
def train_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2, A3: all seven rules, each from the row itself."""
    rows = training_rows(spark, sf_dir)
    frames = event_frames(spark, sf_dir)
    return gated(rows, frames, table(spark, sf_dir, "benchmark")).groupBy("rule").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first_part"))


def gated(rows: DataFrame, frames: DataFrame, benchmark: DataFrame) -> DataFrame:
    """p_partkey and the first rule that drops the row, or null."""
    # trees are parsed once, and frames told by signature once: each is read several times below
    facts = shared.table(tree_rows.facts(rows, "p_partkey", "tree", EVENTS), "facts")
    marked = leakage.first_seen(facts, ["tree_key"], ["p_partkey"])
    # each different tree runs once; their number is the gate's own bound, as they are columns of one scan
    different = tree_rows.alike(facts.where("code is null"), "p_partkey").join(rows, "p_partkey").select("tree_key", "tree").collect()
    trees = {r.tree_key: P.from_json(r.tree) for r in different}
    selected = matching.matches(frames, trees, EVENTS).withColumnRenamed("candidate", "tree_key")
    gold = matching.matches(frames, GATE_GOLD, EVENTS).withColumnRenamed("candidate", "gold")
    signed = shared.table(matching.signatures(selected, "tree_key"), "signatures")
    alike = matching.same_frames(selected, gold, "tree_key", "gold", signed=signed).select("tree_key", F.lit(True).alias("same_frames")).distinct()
    every = F.broadcast(frames.agg(F.count("*").alias("frames")))  # one row
    full = signed.select("tree_key", "n").join(every, F.lit(True))
    texts = leakage.overlaps(rows.select("p_partkey", F.col("request").alias("text")), benchmark, "p_partkey", "item_id").select("p_partkey").distinct().withColumn("overlaps", F.lit(True))
    mentions = shortcuts.hits(filter_text.references(F.col("filter")), F.create_map(F.lit("event.user"), F.lit("FT_UINT32")), F.col("request"))
    joined = marked.join(rows.select("p_partkey", "request"), "p_partkey").join(texts, "p_partkey", "left").join(full, "tree_key", "left").join(alike, "tree_key", "left")
    rule = leakage.drop_rule({
        "compile": F.col("code").isNotNull(), "dev_test_key": F.col("tree_key").isin(*[P.key(t) for t in GATE_GOLD.values()]), "duplicate_key": F.col("duplicate"), "shortcut": F.size(mentions) > 0,
        "dev_test_text": F.col("overlaps"), "degenerate": _degenerate(F.col("n"), F.col("frames")), "dev_test_frames": F.col("same_frames"),
    })
    return joined.select("p_partkey", rule.alias("rule"))


def _degenerate(selected: Column, frames: Column) -> Column:
    """No frame on any probe, or every frame on every probe."""
    return selected.isNull() | (selected == frames)


# Two cases with one failure for each counter planted. Purchases are the feedback probe.
_AT = "user_id < 50 AND k >= 40"
_FIRST = Both((Leaf("event.user", "lt", 50), Leaf("event.k", "ge", 40)))
_SAME = Both((Leaf("event.k", "ge", 40), Leaf("event.user", "lt", 50)))
_PAID = Leaf("event.paid", "exists")
GATE_CATALOG = EVENTS | {"event.gone": Field("event.gone", "integer", "gone")}
GATE_MUTANTS = (
    *mutants.mutants(_FIRST, mutants.Slips(swaps={"event.k": ("event.pair", "event.gone", "event.blob")}, ports={}, numbers={}, flag_bits={}, codes={})),
    mutants.Mutant("planted", "same meaning", Both((_FIRST, Either((Leaf("event.user", "lt", 50), Neither(Leaf("event.user", "exists"))))))), mutants.Mutant("planted", "not in feedback", Both((_FIRST, Neither(_PAID)))),
    mutants.Mutant("planted", "in feedback only", Both((_FIRST, _PAID))), mutants.Mutant("planted", "told twice", _FIRST),
)
_WAIVED = (("good", "same meaning"), ("good", "not in feedback"), ("good", "drop nothing"))


def gate_cases() -> list[adequacy.Case]:
    good = adequacy.Case("good", F.expr(_AT), _SAME, _FIRST, Leaf("event.user", "lt", 50), F.expr("user_id < 50"), GATE_MUTANTS)
    bad = adequacy.Case("bad", F.expr(_AT), Leaf("event.k", "ge", 40), Leaf("event.user", "lt", 50), _SAME, F.expr("k >= 40"), (mutants.Mutant("planted", "unwaived", _FIRST),))
    return [good, bad]


def gate(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(mutants, counters)."""
    frames, cases = event_frames(spark, sf_dir), gate_cases()
    rows, trees = adequacy.prepared(cases, GATE_CATALOG, frames.columns)
    found = adequacy.measured(frames, cases, trees, GATE_CATALOG, F.col("probe_id") == "purchase")
    waivers = spark.createDataFrame(list(_WAIVED), "case_id string, edit string")
    rated = adequacy.statuses(spark, rows, found, waivers)
    return rated, adequacy.counters(spark, rows, found, rated, waivers)


_rows, _trees = adequacy.prepared([adequacy.Case("good", None, _SAME, _FIRST, Leaf("event.user", "lt", 50), None, GATE_MUTANTS)], GATE_CATALOG, ("user_id", "k", "value", "event_type", "large", "pair", "addr", "paid"))
_run = " UNION ALL ".join(f"SELECT '{t}' AS filter, bool_or(({_AT}) <> {sql(x, GATE_CATALOG)}) FILTER (probe_id <> 'purchase') AS scored, bool_or(({_AT}) <> {sql(x, GATE_CATALOG)}) FILTER (probe_id = 'purchase') AS seen FROM frames" for (_, t), x in _trees.items())
_listed = ", ".join(f"('{c}', '{e}', {repr(t) if t else 'NULL'}, '{s}')" for _, role, c, e, t, s in _rows if role == "mutant")


@query("adequacy_gate", f"""WITH {EVENTS_SQL}, run AS ({_run}), m(category, edit, filter, state) AS (VALUES {_listed}),
    x AS (SELECT category, edit, CASE WHEN state <> 'runs' THEN state WHEN scored THEN 'killed' ELSE 'survived' END AS status, coalesce(seen, FALSE) AS seen FROM m LEFT JOIN run USING (filter) WHERE state <> 'duplicate')
    SELECT 'good' AS case_id, category, edit, status, seen, status = 'killed' AND NOT seen AS blind, status = 'survived' AND edit IN ('same meaning', 'not in feedback', 'drop nothing') AS waived FROM x
    UNION ALL SELECT 'bad', 'planted', 'unwaived', 'survived', FALSE, FALSE, FALSE""")
def adequacy_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of every mutant."""
    return gate(spark, sf_dir)[0].select("case_id", "category", "edit", "status", "seen", "blind", "waived")


_apart = lambda label, test: f"(SELECT count(*) FROM (SELECT 1 FROM frames GROUP BY probe_id HAVING bool_or(({label}) <> ({test}))))"


@query("adequacy_counters", f"""WITH {EVENTS_SQL}, run AS ({_run}), m(category, edit, filter, state) AS (VALUES {_listed}), x AS (SELECT edit, scored, seen FROM m JOIN run USING (filter) WHERE state = 'runs')
    SELECT 'label_mismatches' AS counter, CAST({_apart(_AT, 'k >= 40')} AS BIGINT) AS n UNION ALL SELECT 'canonical_mismatches', {_apart(_AT, 'user_id < 50')} UNION ALL SELECT 'mutation_label_mismatches', {_apart('k >= 40', _AT)}
    UNION ALL SELECT 'undistinguished_mutations', 1 + (SELECT count(*) FROM (SELECT bool_or(({_AT}) <> (user_id < 50)) AS d FROM frames WHERE probe_id <> 'purchase') WHERE NOT d)
    UNION ALL SELECT 'feedback_undistinguished_mutations', 1 + (SELECT count(*) FROM (SELECT bool_or(({_AT}) <> (user_id < 50)) AS d FROM frames WHERE probe_id = 'purchase') WHERE NOT d)
    UNION ALL SELECT 'unwaived_survivors', 1 + (SELECT count(*) FROM x WHERE NOT scored AND edit NOT IN ('same meaning', 'not in feedback')) UNION ALL SELECT 'stale_waivers', 1 + (SELECT count(*) FROM x WHERE scored AND edit IN ('same meaning', 'not in feedback'))
    UNION ALL SELECT 'feedback_blind_mutants', (SELECT count(*) FROM x WHERE scored AND NOT seen) UNION ALL SELECT 'disproved_waivers', (SELECT count(*) FROM x WHERE NOT scored AND seen AND edit IN ('same meaning', 'not in feedback'))""")
def adequacy_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nine counters of the gate."""
    return gate(spark, sf_dir)[1]


@query("suite_agreement", f"""WITH {EVENTS_SQL} SELECT 'good' AS case_id, TRUE AS oracle_agrees, TRUE AS candidate_agrees, (SELECT bool_or(({_AT}) <> (user_id < 50)) FROM frames WHERE probe_id <> 'purchase') AS mutation_told
    UNION ALL SELECT 'bad', {_apart(_AT, 'k >= 40')} = 0, {_apart(_AT, 'user_id < 50')} = 0, FALSE""")
def suite_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the suite says of each case."""
    frames, cases = event_frames(spark, sf_dir), gate_cases()
    rows, trees = adequacy.prepared(cases, GATE_CATALOG, frames.columns)
    return adequacy.suite(spark, rows, adequacy.measured(frames, cases, trees, GATE_CATALOG, F.col("probe_id") == "purchase"))
