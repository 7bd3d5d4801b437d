import gzip
import hashlib
import json
import struct

import pytest
from pyspark.sql import functions as F

from packsieve.functions import jsons, networks, text
from packsieve.operators import audits, leakage, retrieval, runs
from packsieve.sources import captures, catalog, records, sinks
from packsieve.streaming import attempts


def tcp(src, dst, sport, dport, flags, seq, ack, payload=b""):
    body = struct.pack("!HHIIBBHHH", sport, dport, seq, ack, 0x50, flags, 8192, 0, 0) + payload
    return b"\0" * 12 + b"\x08\0" + struct.pack("!BBHHHBBHII", 0x45, 2, 20 + len(body), 1, 0, 64, 6, 0, src, dst) + body


def udp(src, dst, sport, dport, payload=b""):
    body = struct.pack("!HHHH", sport, dport, 8 + len(payload), 0) + payload
    return b"\0" * 12 + b"\x08\0" + struct.pack("!BBHHHBBHII", 0x45, 0, 20 + len(body), 1, 0, 1, 17, 0, src, dst) + body


def pcap(packets):
    return struct.pack("<IHHIIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1) + b"".join(struct.pack("<IIII", 1, i, len(p), len(p)) + p for i, p in enumerate(packets))


DNS = struct.pack("!6H", 7, 0x8183, 1, 0, 0, 0) + b"\x01a\x07example\0" + struct.pack("!HH", 28, 1)
CAPTURE = pcap([tcp(1, 2, 41001, 443, 2, 500, 0), tcp(2, 1, 443, 41001, 0x12, 900, 501), tcp(1, 2, 41001, 443, 0x10, 501, 901, b"xy"), udp(2, 1, 53, 41002, DNS), udp(3, 4, 5, 6, b"q")])


def test_captures_are_decoded_or_refused(spark, tmp_path):
    (tmp_path / "p1.pcap").write_bytes(CAPTURE)
    (tmp_path / "cut.pcap").write_bytes(CAPTURE[:-3])
    (tmp_path / "other.pcap").write_bytes(b"not a capture")
    files = captures.files(spark, f"file://{tmp_path}/*.pcap")
    rows = captures.widened(captures.decode(files.where("code is null"))).orderBy("probe_id", "frame").collect()
    good = [r for r in rows if r.probe_id == "p1"]
    assert [(r.frame, r.tcp, r.udp, r.dns) for r in good] == [(1, True, False, False), (2, True, False, False), (3, True, False, False), (4, False, True, True), (5, False, True, False)]
    assert good[0].ip_addr == [1, 2] and good[0].tcp_flags_syn and not good[0].tcp_flags_ack and good[2].tcp_len == 2 and good[0].ip_dsfield_ecn == 2
    assert [(r.tcp_rel_seq, r.tcp_rel_ack) for r in good[:3]] == [(0, 0), (0, 1), (1, 1)] and good[3].tcp_port is None
    assert (good[3].dns_flags_rcode, good[3].dns_qry_type, good[3].dns_flags_response) == (3, 28, True) and good[4].dns_flags_rcode is None
    assert {r.probe_id: r.error for r in rows if r.error} == {"cut": "record is cut short", "other": "not a little-endian Ethernet PCAP 2.4"}
    digests = spark.createDataFrame([("p1", "0" * 64)], "probe_id string, sha256 string")
    assert {r.probe_id: r.code for r in captures.files(spark, f"file://{tmp_path}/p*.pcap", digests, 10_000).collect()} == {"p1": "changed"}
    assert {r.code for r in captures.files(spark, f"file://{tmp_path}/p*.pcap", None, 10).collect()} == {"too_long"}


def test_ack_seen_first_sets_the_base(spark):
    rows = [("p", 1, 2, 1, 443, 41000, 16, 70, 901, True), ("p", 2, 1, 2, 41000, 443, 16, 900, 70, True)]
    df = spark.createDataFrame(rows, "probe_id string, frame int, ip_src long, ip_dst long, tcp_srcport int, tcp_dstport int, tcp_flags int, tcp_seq long, tcp_ack long, tcp boolean")
    assert [(r.tcp_rel_seq, r.tcp_rel_ack) for r in captures.relative(df).orderBy("frame").collect()] == [(0, 1), (0, 0)]


@pytest.mark.parametrize("damage", [lambda p: p[:12] + b"\x86\xdd" + p[14:], lambda p: p[:20] + b"\x20\x00" + p[22:], lambda p: p[:46] + b"\x20" + p[47:], lambda p: p[:23] + b"\x01" + p[24:]])
def test_packets_out_of_bounds_are_refused(damage):
    with pytest.raises(captures.Unreadable):
        captures.packet(damage(tcp(1, 2, 3, 4, 2, 5, 6)))


def test_tails_are_numbered_on_and_numbering_is_checked(spark):
    f = spark.createDataFrame([("p", 1), ("p", 2), ("q", 1)], "probe_id string, frame int")
    tail = spark.createDataFrame([("p", 1), ("q", 1), ("q", 2)], "probe_id string, frame int")
    both = captures.appended(f, tail)
    assert sorted(map(tuple, both.collect())) == [("p", 1), ("p", 2), ("p", 3), ("q", 1), ("q", 2), ("q", 3)]
    assert captures.misnumbered(both, ["probe_id"]).count() == 0 and captures.misnumbered(both.where("frame <> 2"), ["probe_id"]).count() == 2


def test_catalog_reports(spark, tmp_path):
    report = "P\tTransmission Control Protocol\ttcp\nF\tDestination Port\ttcp.dstport\tFT_UINT16\ttcp\tBASE_DEC\nF\tOdd\ttcp.odd\tFT_NEW\ttcp\t\nF\tOdd\ttcp.odd\tFT_UINT8\ttcp\t\nV\ttcp.dstport\t0x50\thttp\n  and more\nV\ttcp.dstport\tx\ty\nR\tt\t1\t2\tz\n"
    (tmp_path / "fields.txt").write_text(report)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")  # several blocks in one file
    try:
        got = [r.record for r in catalog.records(catalog.lines(spark, f"file://{tmp_path}/fields.txt")).collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert "V\ttcp.dstport\t0x50\thttp\n  and more" in got and len(got) == 7
    rows = spark.createDataFrame([(r,) for r in got], "record string")
    f = catalog.fields(rows)
    assert {(r.name, r.kind) for r in f.collect()} == {("tcp", "protocol"), ("tcp.dstport", "integer"), ("tcp.odd", "unsupported"), ("tcp.odd", "integer")}
    assert {(r.value, None if r.number is None else int(r.number)) for r in catalog.values(rows).collect()} == {("0x50", 80), ("x", None)}
    used = spark.createDataFrame([("tcp.odd",), ("tcp.dstport",), ("no",)], "name string")
    assert {r.name: r.code for r in catalog.bind(used, f).collect()} == {"tcp.odd": "conflict", "tcp.dstport": None, "no": "unknown_field"}
    assert {r.name: r.raw for r in catalog.raw_types(used, f).collect()} == {"tcp.dstport": "FT_UINT16"}
    n, digest = catalog.freeze(rows, f"file://{tmp_path}/frozen")
    assert n == 7 and catalog.freeze(rows.repartition(3), f"file://{tmp_path}/frozen2") == (n, digest)
    ordered = sorted(r.encode() for r in got)
    by_name = sorted(got, key=lambda r: ((r.split("\t")[2] if r[0] in "FP" else r.split("\t")[1]).encode(), r.encode()))
    assert len(ordered) == 7 and digest == hashlib.sha256(b"".join(len(r.encode()).to_bytes(8, "big") + r.encode() for r in by_name)).hexdigest()
    assert catalog.opened(spark, f"file://{tmp_path}/frozen").count() == 7
    with pytest.raises(catalog.TooLarge):
        catalog.opened(spark, f"file://{tmp_path}/frozen", 10)


def test_records_and_sinks(spark, tmp_path):
    (tmp_path / "a.jsonl.gz").write_bytes(gzip.compress(b'{"candidate": 1, "request": "x", "frames": [1, 2]}\n'))
    assert records.jsonl(spark, f"file://{tmp_path}/a.jsonl.gz", records.TRAINING).first().frames == [1, 2]
    (tmp_path / "run/r1/C1").mkdir(parents=True)
    (tmp_path / "run/r1/C1/mei-0001.json").write_text(json.dumps({"outcome": "strong_exact", "item_id": "mei-0001"}, indent=1))
    row = records.run_directory(spark, f"file://{tmp_path}/run", "outcome string, item_id string").first()
    assert (row.run, row.path_condition, row.path_item, row.outcome) == ("r1", "C1", "mei-0001", "strong_exact")
    (tmp_path / "o.jsonl").write_text('{"probe_id": "p", "candidate_frames": [3, 4]}\n')
    assert records.observations(spark, f"file://{tmp_path}/o.jsonl").count() == 2
    df = spark.createDataFrame([("b", None, 2), ("a", "é", 1)], "z string, a string, m int").withColumn("s", F.struct(F.lit(1).alias("y"), F.lit(2).alias("b")))
    sinks.write_jsonl(df, f"file://{tmp_path}/out", ["z"], files=1)
    assert [r.value for r in spark.read.text(f"file://{tmp_path}/out").collect()] == ['{"a":"é","m":1,"s":{"b":2,"y":1},"z":"a"}', '{"a":null,"m":2,"s":{"b":2,"y":1},"z":"b"}']
    for n in (3, 4):
        sinks.replace(spark, lambda p, n=n: spark.range(n).write.parquet(p), f"file://{tmp_path}/tree")
        assert spark.read.parquet(f"file://{tmp_path}/tree").count() == n
    assert [p.name for p in tmp_path.iterdir() if "tree" in p.name] == ["tree"]
    assert sinks.check(df, df.withColumn("m", F.col("m") + 1).where("z = 'a'"), ["z"]).count() == 2
    assert "| a | 0.333 |" in sinks.markdown(spark.createDataFrame([("a|", 1 / 3)], "k string, v double"), "T")
    sinks.pages(df, "z", f"file://{tmp_path}/pages")
    assert spark.read.text(f"file://{tmp_path}/pages/z=a").first().value.startswith("[{")


def test_text_functions(spark):
    c = F.col
    df = spark.createDataFrame([("Straße 7 naïve_x A.b-c", "wdgt", "widget")], "t string, k string, w string")
    r = df.select(
        text.unicode_words(c("t")).alias("u"), text.lexemes(c("t")).alias("l"), text.abbreviates(c("k"), c("w")).alias("a"), text.abbreviates(F.lit("wgd"), c("w")).alias("b"),
        text.singular(F.lit("queries")).alias("q"), text.singular(F.lit("ties")).alias("y"), text.initials(F.array(F.lit("domain"), F.lit("name"), F.lit("10"))).alias("i"),
        text.mentions(F.lit("from 10.1.2.3."), F.lit("10.1.2.3")).alias("m1"), text.mentions(F.lit("from 10.1.2.30"), F.lit("10.1.2.3")).alias("m2"), text.cut_bytes(F.lit("aéé"), 4).alias("cut"),
        text.ngrams(F.array(F.lit("a"), F.lit("b")), 3).alias("g"), text.integer_literal(F.lit("017")).alias("oct"), text.leading_verdict(F.lit("PASSing"), ["PASS"]).alias("v"),
        networks.address(F.lit("256.1.1.1")).alias("bad"), networks.stated(F.lit("in 10/8, 192.0.2.0/33 and 1.2.3.4/32")).alias("nets"), jsons.repeats_a_key(F.lit('{"a":1,"a":2}')).alias("dup"),
    ).first()
    assert r.u == ["straße", "7", "naïve", "x", "a", "b", "c"] and r.l[-1] == "a.b-c" and r.a and not r.b and (r.q, r.y, r.i) == ("query", "ties", "dn10")
    assert r.m1 and not r.m2 and r.cut == "aé" and r.g == [] and r.oct == 15 and r.v is None and r.bad is None and r.dup
    assert [(n.lo, n.hi) for n in r.nets] == [(10 << 24, (11 << 24) - 1), (0x01020304, 0x01020304)]
    assert jsons.path("/a~1b/0/c~0d") == "$['a/b'][0]['c~d']"


def test_retrieval_ranks_by_name_and_abbreviation(spark):
    fields = spark.createDataFrame(
        [("tcp.dstport", "integer", "tcp", "Destination Port"), ("tcp.srcport", "integer", "tcp", "Source Port"), ("dns.qry.name", "string", "dns", "Name"), ("dns.a", "ipv4", "dns", "Address"), ("udp.dstport", "integer", "udp", "Destination Port")],
        "name string, kind string, protocol string, display string",
    )
    asked = [("1", "Show TCP destination port traffic", ["tcp"]), ("2", "Match the DNS query name", ["dns"])]
    q = spark.createDataFrame(asked, "item_id string, intent string, protocols array<string>").select("item_id", text.unicode_words(F.col("intent")).alias("words"), "protocols", text.lexemes(F.col("intent")).alias("lexemes"))
    top = {r.item_id: r.name for r in retrieval.top_fields(retrieval.scored(q, fields), 3).where("rank = 1").collect()}
    assert top == {"1": "tcp.dstport", "2": "dns.qry.name"}
    bad = spark.createDataFrame([("a" * 300, "x"), ("b", "x" * 5000), ("c", "w " * 65), ("d", " .,"), ("e", "ok")], "item_id string, intent string")
    assert [r.code for r in retrieval.refused(bad).collect()] == ["item_id_too_long", "query_too_long", "query_too_many_tokens", "query_empty", None]


def test_crowded_ranges_meet_in_many_tasks(spark):
    rows = [(i, i * 100 % 5000, i * 100 % 5000 + i * 7 % 300) for i in range(600)]
    ranges = spark.createDataFrame(rows, "k long, lo long, hi long").coalesce(1)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(networks, "BLOCK", 60)
        met = networks.overlapping(ranges, "k", "lo", "hi", 512)
        assert met.rdd.getNumPartitions() == 100
        got = sorted(map(tuple, met.collect()))
    assert got == sorted((a, b) for a, x, y in rows for b, u, v in rows if a < b and x <= v and u <= y)
    assert sorted(map(tuple, networks.overlapping(ranges, "k", "lo", "hi", 512).collect())) == got


def test_examples_are_counted_in_as_many_tasks_as_their_pairs_need(spark):
    pool = spark.createDataFrame([(i, ["a", f"w{i % 7}"]) for i in range(100)], "id long, words array<string>")
    queries = spark.createDataFrame([(i, ["a", f"w{i}"]) for i in range(10)], "id long, words array<string>")
    want = sorted(map(tuple, retrieval.examples(queries, pool, 3).collect()))
    with pytest.MonkeyPatch.context() as m:
        m.setattr(retrieval, "TASK_PAIRS", 50)
        few = retrieval.examples(queries, pool, 3)
        assert "hashpartitioning(id" in (plan := few._jdf.queryExecution().executedPlan().toString()) and ", 20), REPARTITION_BY_NUM" in plan
        assert sorted(map(tuple, few.collect())) == want


def test_queries_of_the_same_words_are_ranked_once(spark):
    fields = spark.createDataFrame([(f"ip.f{i:02}", "integer", "ip", f"Field {i % 3}") for i in range(30)], "name string, kind string, protocol string, display string")
    asked = [(i, ["field", str(i % 2)], ["ip"], []) for i in range(12)]
    q = spark.createDataFrame(asked, "item_id long, words array<string>, protocols array<string>, lexemes array<string>")
    best = retrieval.best(q, fields, 4)
    plan = best._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Window")  # each query gets its rows when only the k best are left
    got = sorted(best.select("item_id", "name", "score", "rank").collect())
    assert got == sorted(retrieval.top_fields(retrieval.scored(q, fields), 4).select("item_id", "name", "score", "rank").collect()) and len(got) == 48


def test_protocols_are_named_by_acronym_shaped_words(spark):
    known = spark.createDataFrame([("ip", "Internet Protocol Version 4"), ("IPV6", "Internet Protocol Version 6"), ("tcp", "Transmission Control Protocol"), ("find", "Find Protocol"), ("alt", "Interim Packet Volume 4"), ("no", "No")], "name string, display string")
    asked = {"cased": "Find IPv4 destination traffic", "lower": "find ipv4 destination", "one": "Tcp or TCP, UdP?", "plain": "xyzzy", "none": None, "script": "Тест ТЕСТ"}
    got = {r.item_id: set(r.protocols) for r in retrieval.selected_protocols(spark.createDataFrame(list(asked.items()), "item_id string, intent string"), known).collect() if r.protocols is not None}
    assert got["cased"] == {"ipv4", "ip", "alt"} and got["lower"] == {"find", "ipv4", "destination", "ip", "alt"}
    assert got["one"] == {"tcp", "udp"} and got["plain"] == {"xyzzy"} and not got.get("none") and got["script"] == {"тест"}
    # with them, a short field of the protocol that the request names comes before longer names that hold its words
    rows = [("ip.dst", "ipv4", "ip", "Destination Address"), ("ip.ttl", "integer", "ip", "Time to Live"), ("tcp", "protocol", "tcp", "Transmission Control Protocol"), ("find", "protocol", "find", "Find Protocol"),
            ("eigrp.ipv4.destination", "ipv4", "eigrp", "Destination"), ("mpls_echo.tlv.ilso_ipv4.ttl", "integer", "mpls_echo", "TTL"), ("aeron.setup.ttl", "integer", "aeron", "TTL")]
    fields = spark.createDataFrame(rows, "name string, kind string, protocol string, display string")
    asked = {"cased": "Find IPv4 destination traffic", "lower": "find ipv4 destination traffic", "ttl": "Keep only TCP packets whose IPv4 TTL is 1 or lower."}
    q = spark.createDataFrame(list(asked.items()), "item_id string, intent string")
    ready = q.select("item_id", F.transform(text.unicode_words(F.col("intent")), text.singular).alias("words"), text.lexemes(F.col("intent")).alias("lexemes")).join(retrieval.selected_protocols(q, known), "item_id")
    ranked = {}
    for r in retrieval.top_fields(retrieval.scored(ready, fields), 16).orderBy("item_id", "rank").collect():
        ranked.setdefault(r.item_id, []).append(r.name)
    assert ranked["ttl"][:2] == ["ip.ttl", "tcp"]
    with pytest.MonkeyPatch.context() as m:  # too many words to send
        m.setattr(retrieval, "BROADCAST_WORDS", 0)
        shuffled = sorted(map(tuple, retrieval.scored(ready, fields).collect()))
    assert shuffled == sorted(map(tuple, retrieval.scored(ready, fields).collect()))
    cased, lowered = ranked["cased"], ranked["lower"]
    assert cased.index("ip.dst") < cased.index("eigrp.ipv4.destination") < cased.index("find") and lowered.index("find") < lowered.index("eigrp.ipv4.destination")


def test_drop_rules_go_in_order_and_overlap_needs_eight_words(spark):
    t, f = F.lit(True), F.lit(False)
    r = spark.range(1).select(leakage.drop_rule({"shortcut": t, "compile": f, "duplicate_key": t}).alias("a"), leakage.drop_rule({"compile": f, "degenerate": F.lit(None).cast("boolean")}).alias("b")).first()
    assert (r.a, r.b) == ("duplicate_key", None)
    a = spark.createDataFrame([(1, "x One two three four five six seven eight y"), (2, "one two three four five six seven"), (3, None)], "a long, text string")
    b = spark.createDataFrame([(9, "one, two. three four five six seven EIGHT")], "b long, text string")
    assert [tuple(x) for x in leakage.overlaps(a, b, "a", "b").collect()] == [(1, 9, 1)]


def test_audits_report_what_is_wrong(spark):
    plan = spark.createDataFrame([(1, 10), (2, 30), (3, 20)], "pos int, listed int")
    assert [r.pos for r in audits.out_of_order(plan, "pos", "listed").collect()] == [3]
    a, b = (spark.createDataFrame([("k", v)], "k string, v array<int>") for v in ([1, 2, 3], [1, 2]))
    assert [tuple(r)[1:] for r in audits.zipped(a, b.withColumnRenamed("v", "w"), ["k"], "v", "w").orderBy("pos").collect()] == [(0, 1, 1), (1, 2, 2), (2, 3, None)]
    hours = spark.sql("select timestamp'2024-01-01 10:00:00' lo, timestamp'2024-01-01 11:00:00' hi")
    rows = spark.sql("select * from values (1, timestamp'2024-01-01 10:00:00', timestamp'2024-01-01 10:59:59'), (2, timestamp'2024-01-01 10:30:00', timestamp'2024-01-01 11:00:00'), (3, timestamp'2024-01-01 09:59:59', timestamp'2024-01-01 10:10:00') t(id, a, b)")
    assert [r.id for r in runs.in_billed_hours(rows, hours, "a", "b").collect()] == [1]


def test_attempt_stream_keeps_the_last(spark, tmp_path):
    (tmp_path / "log").mkdir()
    line = lambda item, n, s: json.dumps({"item_id": item, "attempt": n, "status": s}) + "\n"
    schema, out = "item_id string, attempt int, status string", f"file://{tmp_path}/out"

    def pump():
        stream = attempts.last(attempts.read(spark, f"file://{tmp_path}/log", schema), ["item_id"])
        attempts.write(stream, out, f"file://{tmp_path}/check").awaitTermination(120)
        return {r.item_id: (r.attempts, r.status) for r in attempts.current(spark, out, ["item_id"]).collect()}

    (tmp_path / "log/1.json").write_text(line("a", 1, "failed") + line("b", 1, "completed"))
    assert pump() == {"a": (1, "failed"), "b": (1, "completed")}
    (tmp_path / "log/2.json").write_text(line("a", 2, "completed") + line("a", 1, "failed"))
    assert pump() == {"a": (2, "completed"), "b": (1, "completed")}


def test_a_run_is_written_and_listed_in_tasks_whatever_its_names(spark, tmp_path):
    rows = [("r+1", "C=2/3", f"a {i}%+é", f"text {i}") for i in range(40)]
    path = f"file://{tmp_path}/run"
    records.write_run(spark.createDataFrame(rows, "run string, condition string, item string, value string"), path)
    got = {tuple(r) for r in records.run_files(spark, path).collect()}
    assert got == {(a, b, c, len(v) + 1, hashlib.sha256(f"{v}\n".encode()).hexdigest()) for a, b, c, v in rows}
