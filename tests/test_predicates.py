import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from packsieve.operators import cards, columns, filter_text, matching, mutants, predicates, sampling
from packsieve.operators.predicates import Both, Either, Field, Leaf, Neither, Refused

CATALOG = {f.name: f for f in (Field("a", "integer", "a"), Field("s", "string", "s"), Field("m", "integer", "m", many=True), Field("p", "protocol", "p"), Field("ip", "ipv4", "ip"), Field("x", "unsupported"), Field("u8", "integer", raw="FT_UINT8"), Field("f", "float"))}
ROWS = [
    (1, 1, "one", [1, 2], True, 0x0A000001), (2, None, None, None, None, None), (3, 5, "five", [], False, 0xC0000201), (4, 2, "two", [2, 2], True, 0x0A010203), (5, 3, "", [7], False, 0),
]


def naive(tree, row):
    """Row by row, with Python values: what a column must equal."""
    if isinstance(tree, Neither):
        return not naive(tree.part, row)
    if isinstance(tree, Both):
        return all(naive(p, row) for p in tree.parts)
    if isinstance(tree, Either):
        return any(naive(p, row) for p in tree.parts)
    v = row[CATALOG[tree.field].column]
    if CATALOG[tree.field].kind == "protocol":
        return bool(v)
    seen = ([] if v is None else v) if CATALOG[tree.field].many else ([] if v is None else [v])
    test = {
        "exists": lambda o: True, "eq": lambda o: o == tree.value, "ne": lambda o: o != tree.value, "lt": lambda o: o < tree.value, "le": lambda o: o <= tree.value,
        "gt": lambda o: o > tree.value, "ge": lambda o: o >= tree.value, "in": lambda o: o in tree.value, "contains": lambda o: tree.value in o,
    }[tree.op]
    return bool(seen) and (all if tree.op == "ne" else any)(test(o) for o in seen)


numbers = st.integers(0, 7)
leaf = st.one_of(
    st.builds(Leaf, st.sampled_from(["a", "m"]), st.sampled_from(["eq", "ne", "lt", "le", "gt", "ge"]), numbers), st.builds(Leaf, st.sampled_from(["a", "s", "m", "p"]), st.just("exists")),
    st.builds(Leaf, st.sampled_from(["a", "m"]), st.just("in"), st.tuples(numbers, numbers)), st.builds(Leaf, st.just("s"), st.just("contains"), st.sampled_from(["o", "e", ""])),
)
trees = st.recursive(leaf, lambda t: st.one_of(st.builds(Neither, t), st.builds(Both, st.tuples(t, t)), st.builds(Either, st.tuples(t, t, t))), max_leaves=6)


@pytest.fixture(scope="module")
def frames(spark):
    return spark.createDataFrame(ROWS, "frame int, a int, s string, m array<int>, p boolean, ip long").cache()


@given(st.lists(trees, min_size=12, max_size=12))
@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
def test_columns_equal_a_row_by_row_reading(frames, batch):
    got = frames.select("*", *[columns.column(t, CATALOG).alias(f"t{i}") for i, t in enumerate(batch)]).collect()
    for row in got:
        for i, t in enumerate(batch):
            assert row[f"t{i}"] == naive(t, row.asDict())


@given(trees)
@settings(max_examples=60, deadline=None)
def test_trees_survive_json_and_keys_ignore_order(tree):
    assert predicates.from_json(predicates.to_json(tree)) == tree
    if isinstance(tree, Both | Either):
        assert predicates.key(predicates.rebuilt(tree, tree.parts[::-1])) == predicates.key(tree)


def test_pushed_conditions_lose_no_row(frames):
    for t in (Both((Leaf("a", "gt", 1), Leaf("m", "eq", 2))), Either((Leaf("a", "eq", 1), Leaf("s", "eq", "five"))), Leaf("ip", "in_subnet", "10.0.0.0/8")):
        push = columns.pushable(t, CATALOG)
        assert frames.where(push).where(columns.column(t, CATALOG)).count() == frames.where(columns.column(t, CATALOG)).count() > 0


def test_subnets_allow_host_bits_and_zero(frames):
    ids = lambda net: [r.frame for r in frames.where(columns.column(Leaf("ip", "in_subnet", net), CATALOG)).collect()]
    assert ids("10.9.9.9/8") == [1, 4] and ids("0.0.0.0/0") == [1, 3, 4, 5] and ids("192.0.2.0/24") == [3]


@pytest.mark.parametrize(
    ("x", "code"),
    [
        (Leaf("none", "exists"), "unknown_field"), (Leaf("x", "exists"), "unsupported_type"), (Leaf("s", "lt", "a"), "unsupported_operator"), (Leaf("a", "contains", "a"), "unsupported_operator"),
        (Leaf("p", "eq", True), "unsupported_operator"), (Leaf("a", "eq", True), "type_mismatch"), (Leaf("a", "in", (1, "2")), "type_mismatch"), (Leaf("u8", "eq", 256), "type_mismatch"),
        (Leaf("u8", "eq", 255), None), (Leaf("ip", "in_subnet", "::/8"), "type_mismatch"), (Leaf("ip", "eq", "10.0.0.1"), None), (Leaf("f", "lt", float("inf")), "type_mismatch"), (Leaf("f", "lt", 3), None),
    ],
)
def test_refusals_have_stable_codes(x, code):
    assert predicates.code_of(x, CATALOG) == code


@pytest.mark.parametrize("bad", ['{"kind":"not"}', '{"kind":"all","children":[]}', '{"kind":"predicate","field":"a","operator":"eq","value":1,"more":1}', '{"kind":"predicate","field":"a..b","operator":"exists"}', '{"kind":"predicate","field":"a","operator":"in","value":[]}'])
def test_malformed_nodes_are_refused(bad):
    with pytest.raises(Refused):
        predicates.from_object(json.loads(bad))


def test_canonical_form_flattens_and_keeps_repeats():
    a, b = Leaf("a", "eq", 1), Leaf("a", "in", (3, 2))
    t = predicates.canonical(Both((b, Both((a, a)))))
    assert t == Both((a, a, Leaf("a", "in", (2, 3)))) and predicates.depth(Neither(t)) == 2


def test_text_is_parenthesised_and_escaped():
    t = Both((Leaf("s", "contains", 'a"b\\'), Neither(Either((Leaf("a", "in", (1, 2)), Leaf("ip", "in_subnet", "10.1.2.3/8"))))))
    assert filter_text.text(t, CATALOG) == r'((s contains "a\"b\\") && (!((a in {1, 2}) || (ip == 10.0.0.0/8))))'
    with pytest.raises(Refused):
        filter_text.text(Leaf("s", "eq", "a\n"), CATALOG)


def test_mutants_differ_at_one_place_in_preorder():
    t = Both((Leaf("tcp.dstport", "ge", 80), Neither(Leaf("tcp.flags.syn", "eq", True)), Leaf("ip.src", "in_subnet", "10.0.0.0/8")))
    got = mutants.mutants(t)
    assert [m.category for m in got][:4] == ["drop-conjunct", "field-swap", "field-swap", "boundary"]
    assert {m.category for m in got} == {"drop-conjunct", "field-swap", "boundary", "drop-not", "flag-as-number", "flag-as-byte", "subnet"}
    assert {m.edit for m in got if m.category == "subnet"} == {f"2: ip.src 10.0.0.0/8 -> {n}" for n in ("0.0.0.0/0", "10.0.0.0/9", "10.1.0.0/16")}
    assert len({m.edit for m in got}) == len(got) and all(m.tree != t for m in got)


def test_replies_are_read_strictly():
    tree = predicates.to_object(Leaf("a", "eq", 1))
    ready = {"status": "ready", "intent_ir": {"ir_schema_version": "1.0", "scope": "packet", "expression": tree}}
    assert predicates.read_reply(json.dumps(ready)).tree == Leaf("a", "eq", 1)
    ask = {"status": "needs_clarification", "clarifying_question": "Which?", "missing_slots": ["port"]}
    assert predicates.read_reply(json.dumps(ask)).missing == ("port",)
    for bad in ("{}", "```json\n{}\n```", json.dumps(ready | {"missing_slots": ["x"]}), json.dumps({"status": "ready"}), '"' + "x" * 70000 + '"'):
        with pytest.raises(Refused):
            predicates.read_reply(bad)
    assert predicates.reply_schema()["properties"]["status"]["enum"][0] == "ready"


def test_empty_sets_follow_the_conventions(spark):
    rows = spark.createDataFrame([(0, 0, 0), (0, 2, 0), (3, 0, 0), (4, 2, 1)], "n_expected long, n_candidate long, n_both long")
    got = [(r.precision, r.recall, r.f1, r.jaccard, r.exact) for r in matching.with_metrics(rows).collect()]
    assert got[:3] == [(1, 1, 1, 1, True), (0, 0, 0, 0, False), (0, 0, 0, 0, False)]
    assert got[3] == (0.5, 0.25, pytest.approx(1 / 3), 0.2, False)


def test_verdicts_go_in_order(spark):
    names = ["completed", "parsed", "ready", "gold_ready", "code", "shortcut", "exact", "some"]
    rows = [
        (False, False, False, False, "c", True, True, True), (True, False, False, False, "c", True, True, True), (True, True, False, False, "c", True, True, True), (True, True, True, False, "c", True, True, True),
        (True, True, True, True, "c", True, True, True), (True, True, True, True, None, True, True, True), (True, True, True, True, None, False, True, True), (True, True, True, True, None, True, False, True), (True, True, True, True, None, False, True, False),
    ]
    df = spark.createDataFrame(rows, ", ".join(f"{n} {'string' if n == 'code' else 'boolean'}" for n in names))
    got = [r.v for r in df.select(matching.verdict(*map(F.col, names)).alias("v")).collect()]
    assert got == ["provider_failed", "malformed", "abstained", "false_ready", "invalid", "shortcut", "strong_exact", "silent_wrong", "silent_wrong"]


def test_cards_alternate_and_skip_repeats(spark):
    wrong = spark.createDataFrame([("p", 1, "missed", 41001), ("p", 2, "missed", 50000), ("p", 3, "wrong", 80), ("p", 4, "missed", 22), ("p", 9, "wrong", 81)], "probe_id string, frame int, side string, port int")
    got = cards.chosen(wrong, ["probe_id"], ["port"], ports=["port"]).orderBy("position").collect()
    assert [r.frame for r in got] == [1, 3, 9]


def test_proof_filter_selects_the_frame_alone(frames):
    shown = {n: CATALOG[n] for n in ("a", "s", "m")}
    assert [r.frame for r in frames.where(filter_text.exactly({"a": 2, "s": "two", "m": 2}, shown)).collect()] == [4]
    assert [r.frame for r in frames.where(filter_text.exactly({}, shown)).collect()] == [2]


def test_references_are_scanned_by_kind(spark):
    text = 'tcp.port in {41000..0x1F} || ip.src == 10.0.0.0/8 or dns.qry.name contains "probe-1-2" && eth.src == aa:bb:cc:dd:ee:ff and not udp'
    r = spark.createDataFrame([(text,)], "t string").select(filter_text.references(F.col("t")).alias("r")).first().r
    assert r.fields == ["tcp.port", "ip.src", "dns.qry.name", "eth.src", "udp"] and r.numbers == ["41000", "0x1F"] and r.addresses == ["10.0.0.0/8"]
    assert r.macs == ["aa:bb:cc:dd:ee:ff"] and r.strings == ["probe-1-2"] and r.disjunctions == 2


def test_samples_depend_on_seed_and_number_alone(spark):
    atoms = [sampling.Atom(Leaf(f, "ge", 3), (f"have {f} of 3 or more", f"are {f} three up"), f"slot_{f}", f"have some {f}") for f in "abcd"] + [sampling.Atom(Leaf("e", "eq", False), ("lack e",))]
    some, plain = sampling.Open(), sampling.Open(plain=True)
    grammar = sampling.Grammar(
        [(some, 1), (Both((some, some)), 3), (Neither(Either((plain, plain))), 2), (Both((some, Either((plain, plain)))), 2)], ("List what {}.", "Which {}?"), {f"slot_{f}": f"How much {f}?" for f in "abcd"}, 0.3, 0.3
    )
    rows = sampling.candidates(spark, 5, 300, atoms, grammar).orderBy("candidate").collect()
    for r in rows[::20]:
        c = sampling.sample(5, r.candidate, atoms, grammar)
        assert (r.request, r.key, r.missing) == (c.request, predicates.key(c.tree), c.missing)
    assert len({r.key for r in rows}) > 50 and {r.status for r in rows} == {"ready", "needs_clarification"}
    for r in rows:
        leaves = [x for _, x in predicates.leaves(sampling.sample(5, r.candidate, atoms, grammar).tree)]
        assert len({x.field for x in leaves}) == len(leaves) <= 3 and r.depth <= 3
        assert (r.ir is None) == (r.missing is not None) == (r.question == f"How much {str(r.missing)[-1]}?") and ("have some" in r.request) == (r.ir is None)
    # shares and weights come out, and a negation encloses no leaf that denies
    shapes = [sampling.sample(5, i, atoms, grammar).tree for i in range(2000)]
    assert 0.33 < sum(isinstance(t, Both) and len(t.parts) == 2 and not any(isinstance(p, Either) for p in t.parts) for t in shapes) / 2000 < 0.42  # 3 of 8
    assert not any(isinstance(t, Neither) and isinstance(t.part, Either) and any(x.value is False for x in t.part.parts) for t in shapes)
    says = {Leaf(f, "ge", 3): f"have {f}" for f in "abc"}
    a, b, c = says
    assert sampling.phrase(Both((a, Either((b, c)), Neither(a))), says) == "have a and also - have b or else have c - and also are none of those that have a"
    with pytest.raises(ValueError, match="shape"):
        sampling.sample(5, 0, atoms[:1], sampling.Grammar([(Both((some, some)), 1)], ("{}",)))
    assert sampling.seeded_choice(["c", "a", "b"], 2) == __import__("random").Random(17).sample(["a", "b", "c"], 2)
