"""Trees and replies as rows, against the readers of one text; frame sets told by signature."""

import json
import random

import pytest
from pyspark.sql import functions as F

from packsieve.operators import matching, predicates, replies, tree_rows
from packsieve.operators.predicates import Both, Either, Field, Leaf, Neither, Refused

CATALOG = {f.name: f for f in (Field("a", "integer", "a"), Field("s", "string", "s"), Field("t", "boolean", "t"), Field("p", "protocol", "p"), Field("x", "float", "x"))}


def made(rng, depth):
    if not depth or rng.random() < 0.3:
        return rng.choice([Leaf("a", "lt", rng.randint(-3, 3)), Leaf("s", "in", tuple(rng.sample(["b", "é", "a\"", "a"], 2))), Leaf("s", "eq", "ü\n"), Leaf("t", "eq", True), Leaf("p", "exists"), Leaf("x", "gt", 1.0), Leaf("none", "exists"), Leaf("a", "eq", 1.5)])
    kind = rng.choice([Both, Either, Neither])
    return Neither(made(rng, depth - 1)) if kind is Neither else kind(tuple(made(rng, depth - 1) for _ in range(rng.randint(2, 4))))


def test_rows_of_trees_are_read_as_trees_are(spark):
    rng = random.Random(3)
    trees = [made(rng, 5) for _ in range(300)]
    texts = [predicates.to_json(t) for t in trees]
    deep = '{"kind":"not","child":' * 5000 + "{}" + "}" * 5000
    bad = [None, "", "nope", "[]", texts[0] + " x", texts[0].replace("packet", "flow"), '{"ir_schema_version":"1.0","scope":"packet","expression":' + deep + "}"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts + bad)], "id long, tree string").repartition(5)
    facts = {r.id: r for r in tree_rows.facts(df, "id", "tree", CATALOG).collect()}
    leaves = {}
    for r in tree_rows.leaves(df, "id", "tree").orderBy("id", "pos").collect():
        leaves.setdefault(r.id, []).append((r.path, r.field, r.operator, r.value))
    for i, t in enumerate(trees):
        assert (facts[i].tree_key, facts[i].depth) == (predicates.key(t), predicates.depth(t))
        assert facts[i].code == predicates.refusal(t, CATALOG) or facts[i].code and facts[i].filter is None
        assert [x[:3] for x in leaves[i]] == [(".".join(map(str, p)) or "root", x.field, x.op) for p, x in predicates.leaves(t)]
    assert all(facts[len(trees) + k].code == "malformed" and facts[len(trees) + k].tree_key is None and len(trees) + k not in leaves for k in range(len(bad)))
    kept = tree_rows.alike(tree_rows.facts(df, "id", "tree", CATALOG), "id").collect()
    assert {r.id for r in kept} == {min(i for i, t in enumerate(trees) if predicates.key(t) == k) for k in map(predicates.key, trees)} and sum(r.trees for r in kept) == 300
    assert tree_rows.facts(df.limit(0), "id", "tree", CATALOG).count() == tree_rows.leaves(df.limit(0), "id", "tree").count() == 0


IR = {"ir_schema_version": "1.0", "scope": "packet", "expression": {"kind": "predicate", "field": "a", "operator": "eq", "value": 1}}
TYPED = [
    {"status": "ready", "intent_ir": IR}, {"schema_version": "1.0", "status": "ready", "intent_ir": IR, "assumptions": ["é", "b"], "clarifying_question": None, "missing_slots": []},
    {"status": "needs_clarification", "clarifying_question": "Which?"}, {"status": "needs_clarification", "clarifying_question": "Which?", "missing_slots": ["port", "value"], "intent_ir": None}, {"status": "not_expressible"},
    {"status": "ready"}, {"status": "ready", "intent_ir": IR, "clarifying_question": "x"}, {"status": "ready", "intent_ir": IR, "missing_slots": ["port"]}, {"status": "ready", "intent_ir": "text"}, {"status": "ready", "intent_ir": [IR]},
    {"status": "needs_clarification"}, {"status": "needs_clarification", "clarifying_question": ""}, {"status": "needs_clarification", "clarifying_question": "Which?", "intent_ir": IR}, {"status": "needs_clarification", "clarifying_question": 5},
    {"status": "needs_clarification", "clarifying_question": "Which?", "missing_slots": ["port", "port"]}, {"status": "needs_clarification", "clarifying_question": "Which?", "missing_slots": ["colour"]}, {"status": "needs_clarification", "clarifying_question": "Which?", "missing_slots": None},
    {"status": "not_expressible", "clarifying_question": "x"}, {"status": "not_expressible", "assumptions": "xyz"}, {"status": "not_expressible", "assumptions": [1]}, {"status": "not_expressible", "assumptions": ["a", None]}, {"status": "not_expressible", "assumptions": None},
    {"status": "other"}, {"status": None}, {"status": 1}, {}, {"status": "not_expressible", "extra": 1}, {"schema_version": "2.0", "status": "not_expressible"}, {"schema_version": 1.0, "status": "not_expressible"}, {"status": "not_expressible", "r": 1}, {"status": "not_expressible", "z": 1},
]
TEXTS = [None, "", " ", "nope", "null", "[]", '"x"', "{}{}", '{"status":"not_expressible"} x', 'x {"status":"not_expressible"}', '```json\n{"status":"not_expressible"}\n```', '{"status":"not_expressible"', ' \n{ "status" : "not_expressible" }\t', "{'status':'not_expressible'}", '{"status":"not_expressible",}',
         '{"status":"not_expressible"},"y":{}', '{"status":"not_expressible"}],[{}', json.dumps({"status": "not_expressible", "assumptions": ["é" * 40000]}, ensure_ascii=False), json.dumps({"status": "not_expressible", "assumptions": ["e" * 40000]})]


def test_replies_as_columns_are_those_of_the_strict_reader(spark):
    texts = [json.dumps(x, ensure_ascii=False) for x in TYPED] + TEXTS
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, reply string").select("id", replies.parsed(F.col("reply"), "typed_ir").alias("r")).select("id", "r.*").collect()
    taken = 0
    for r in rows:
        text = texts[r.id]
        try:
            want = predicates.read_reply(text) if text is not None else None
        except Refused:
            want = None
        if want is None:
            assert r.code == "malformed" and r.status is None and r.missing is None, (text, r)
        else:
            taken += 1
            assert (r.code, r.status, r.question, tuple(r.missing), tuple(r.assumptions)) == (None, want.status, want.question, want.missing, want.assumptions), (text, r)
            assert (json.loads(r.payload) if r.payload else None) == (IR if want.tree else None)
    assert taken >= 7
    twice = spark.createDataFrame([('{"status":"ready","status":"not_expressible"}',)], "reply string").select(replies.parsed(F.col("reply"), "typed_ir").alias("r")).first().r
    assert twice.code == "malformed"


@pytest.mark.parametrize(("payload", "ok"), [("tcp.dstport == 443", True), ("", False), (" \t", False), ("a\tb", False), ("é" * 2048, True), ("é" * 2049, False), (5, False), (None, False), ({"a": 1}, False)])
def test_filter_replies_take_text_of_their_own_contract_only(spark, payload, ok):
    reply = json.dumps({"status": "ready", "display_filter": payload}, ensure_ascii=False)
    other = json.dumps({"schema_version": "direct-filter/1.0", "status": "not_expressible"})
    rows = spark.createDataFrame([(reply, other)], "a string, b string").select(replies.parsed(F.col("a"), "display_filter").alias("a"), replies.parsed(F.col("a"), "typed_ir").alias("t"), replies.parsed(F.col("b"), "display_filter").alias("b"), replies.parsed(F.col("b"), "typed_ir").alias("c")).first()
    assert (rows.a.code is None) == ok and rows.a.payload == (payload if ok else None)
    assert rows.t.code == rows.c.code == "malformed" and rows.b.status == "not_expressible"


def test_equal_frame_sets_have_equal_signatures(spark):
    sets = {"a": {("p", 1), ("p", 2), ("q", 1)}, "b": {("q", 1), ("p", 2), ("p", 1)}, "c": {("p", 1), ("p", 2), ("q", 2)}, "d": {("p", 1), ("p", 2)}, "e": {("p", 3)}}
    rows = spark.createDataFrame([(k, p, f) for k, s in sets.items() for p, f in sorted(s, reverse=k == "b")], "mine string, probe_id string, frame int")
    got = {(r.mine, r.other, r.n) for r in matching.same_frames(rows, rows.withColumnRenamed("mine", "other"), "mine", "other").collect()}
    assert got == {(k, o, len(sets[k])) for k in sets for o in sets if sets[k] == sets[o]}
    # hashes alone don't decide: sets of equal signature and different frames are told apart
    odd = spark.createDataFrame([("x", "p", 1)], "mine string, probe_id string, frame int")
    assert matching.same_frames(odd, odd.withColumnRenamed("mine", "other").withColumn("frame", F.lit(2)), "mine", "other").count() == 0


def test_the_gate_parses_trees_once(spark):
    from packsieve.plans import trees as plans

    plan = plans.train_gate(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapIn" not in plan and "EvalPython" not in plan  # parsed before, and read from there
