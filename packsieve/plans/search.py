"""Queries of retrieval, examples, overlap, shortcuts and text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packsieve.functions import jsons, networks, text
from packsieve.operators import classes, filter_text, leakage, retrieval, shortcuts
from packsieve.plans.frames import dealt, table
from packsieve.sources import shared

QUERIES, SQL = {}, {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            SQL[name] = oracle
        return f

    return add


# Parts as a field catalog: name "part.<words joined by _>_<key>", protocol the type, display the name; queries are a
# word of the brand's parts, a long word and a type.
def fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(
        F.concat(F.lower("p_type"), F.lit("."), F.regexp_replace("p_name", " ", "."), F.lit("."), F.col("p_partkey").cast("string")).alias("name"), F.lit("integer").alias("kind"),
        F.lower("p_type").alias("protocol"), F.concat("p_name", F.lit(" "), F.lower("p_brand")).alias("display"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    pick = lambda words, n: F.element_at(F.array(*map(F.lit, words)), (n % len(words) + 1).cast("int"))
    protocol = pick(["EPV7", "Promo", "ECONOMY", "epv7", ""], F.floor(k / 5))
    intent = F.concat_ws(" ", F.lit("Show"), pick(["small", "red", "blue", "large", "gree"], k), pick(["widget", "bolt", "ring", "gearing", "smaller"], k + F.floor(k / 5)), F.lit("brand"), (k % 25).cast("string"), protocol)
    return s.select(k.alias("item_id"), F.when(k % 3 == 0, F.lower(intent)).otherwise(intent).alias("intent"))


def protocols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A protocol for each type of part; its display name has the type's first letter, a P, a V and the length of the type for initials."""
    p = table(spark, sf_dir, "part").select(F.lower("p_type").alias("name")).distinct()
    return p.select("name", F.concat(F.initcap("name"), F.lit(" Part Version "), F.length("name").cast("string")).alias("display"))


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests as retrieval takes them, with the protocols that they name."""
    q = requests(spark, sf_dir)
    words = q.select("item_id", F.transform(text.unicode_words(F.col("intent")), text.singular).alias("words"), text.lexemes(F.col("intent")).alias("lexemes"))
    return words.join(retrieval.selected_protocols(q, protocols(spark, sf_dir)), "item_id")


_INTENTS = """i AS (SELECT s_suppkey AS item_id, 'Show ' || ['small', 'red', 'blue', 'large', 'gree'][s_suppkey % 5 + 1] || ' ' || ['widget', 'bolt', 'ring', 'gearing', 'smaller'][(s_suppkey + s_suppkey // 5) % 5 + 1] || ' brand ' || (s_suppkey % 25)
        || ' ' || ['EPV7', 'Promo', 'ECONOMY', 'epv7', ''][(s_suppkey // 5) % 5 + 1] AS told FROM supplier),
    ic AS (SELECT item_id, trim(CASE WHEN item_id % 3 = 0 THEN lower(told) ELSE told END) AS intent FROM i),
    it AS (SELECT item_id, intent, unnest(string_split(intent, ' ')) AS token FROM ic),
    named AS (SELECT DISTINCT item_id, lower(token) AS word FROM it WHERE intent = lower(intent) OR length(regexp_replace(token, '[^A-Z]', '', 'g')) >= 2),
    acronym AS (SELECT DISTINCT lower(p_type) AS protocol, lower(p_type)[1] || 'pv' || length(p_type) AS acronym FROM part),
    qp AS (SELECT item_id, word AS proto FROM named UNION SELECT item_id, protocol FROM named JOIN acronym ON word = acronym)"""
_REQUESTS = f"""{_INTENTS}, q AS (SELECT item_id, lower(intent) AS intent FROM ic),
    qw AS (SELECT DISTINCT item_id, w AS word FROM (SELECT item_id, unnest(string_split(intent, ' ')) AS w FROM q)),
    f AS (SELECT lower(p_type) || '.' || replace(p_name, ' ', '.') || '.' || p_partkey AS name, lower(p_type) AS protocol, p_name || ' ' || lower(p_brand) AS display FROM part),
    ab AS (SELECT DISTINCT name, unnest(string_split(name, '.')) AS token FROM f), ds AS (SELECT DISTINCT name, unnest(regexp_extract_all(display, '[a-z0-9]+')) AS word FROM f),
    hit AS (SELECT item_id, name, word, word AS covers, 4 AS weight FROM qw JOIN ab ON word = token
        UNION ALL SELECT item_id, name, qw.word, NULL, 4 FROM qw JOIN ds ON qw.word = ds.word
        UNION ALL SELECT item_id, name, word, token, 2 FROM qw JOIN ab ON length(token) >= 3 AND length(token) < length(word) AND length(word) <= 32 AND regexp_matches(word, '^' || array_to_string(string_split(token, ''), '.*'))
        UNION ALL SELECT item_id, name, NULL, proto, 4 FROM qp JOIN f ON protocol = proto),
    pw AS (SELECT item_id, name, word, max(weight) AS weight FROM hit GROUP BY ALL), raw AS (SELECT item_id, name, sum(weight) AS raw FROM pw GROUP BY ALL),
    cov AS (SELECT DISTINCT item_id, name, covers FROM hit JOIN ab USING (name) WHERE covers = token), nc AS (SELECT item_id, name, count(*) AS n FROM cov GROUP BY ALL),
    na AS (SELECT name, count(*) AS n FROM ab GROUP BY 1),
    scored AS (SELECT raw.item_id, raw.name, CAST(raw.raw * 1000 // (2 + na.n - coalesce(nc.n, 0)) AS BIGINT) AS score FROM raw JOIN na USING (name) LEFT JOIN nc ON nc.item_id = raw.item_id AND nc.name = raw.name),
    ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, name) AS INTEGER) AS rank FROM scored)"""


def ranked(spark: SparkSession, sf_dir: str, k: int = 16) -> DataFrame:
    return retrieval.best(prepared(spark, sf_dir), fields(spark, sf_dir), k)


@query("protocol_selection", f"WITH {_INTENTS} SELECT item_id, proto AS protocol FROM qp")
def protocol_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The protocols that a request names by their own name or by the acronym of their display name."""
    return retrieval.selected_protocols(requests(spark, sf_dir), protocols(spark, sf_dir)).select("item_id", F.explode("protocols").alias("protocol"))


@query("field_retrieval_topk", f"WITH {_REQUESTS} SELECT item_id, name, score, rank FROM ranked WHERE rank <= 16")
def field_retrieval_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W1, J6, F24."""
    return ranked(spark, sf_dir).select("item_id", "name", "score", "rank")


@query("context_budget", f"""WITH {_REQUESTS}, b AS (SELECT item_id, name, rank, CAST(1 + sum(length(name) + 10 + 1) OVER (PARTITION BY item_id ORDER BY rank) AS BIGINT) AS bytes FROM ranked WHERE rank <= 16)
    SELECT item_id, name, rank, bytes FROM b WHERE bytes <= 256""")
def context_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W2."""
    return retrieval.within_bytes(ranked(spark, sf_dir), ["item_id"], F.octet_length("name") + 10, 256).select("item_id", "name", "rank", "bytes")


_GOLD = "g AS (SELECT DISTINCT item_id, name FROM (SELECT item_id, name, rank FROM ranked WHERE rank IN (1, 3, 20, 90)))"


@query("recall_at_k", f"""WITH {_REQUESTS}, {_GOLD}, h AS (SELECT g.item_id, rank FROM g JOIN ranked USING (item_id, name)),
    p AS (SELECT k, item_id, count(*) AS gold, count(*) FILTER (rank <= k) AS hits FROM h, (VALUES (1), (4), (16)) t(k) GROUP BY ALL)
    SELECT count(*) AS items, CAST(k AS INTEGER) AS k, count(*) FILTER (hits = gold) AS all_found, round(avg(hits / gold::DOUBLE), 6) AS macro, round(sum(hits) / sum(gold)::DOUBLE, 6) AS micro FROM p GROUP BY k""")
def recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold fields are those at four ranks."""
    at = (1, 3, 20, 90)
    path = shared.folder(spark, "ranked")
    ranked(spark, sf_dir, max(at)).write.parquet(path)
    all_ranked = spark.read.parquet(path)
    gold = all_ranked.where(F.col("rank").isin(*at)).select("item_id", "name")
    return retrieval.recall(all_ranked.where("rank <= 16"), gold, [1, 4, 16]).withColumns({c: F.round(c, 6) for c in ("macro", "micro")})


_CONTENT = "list_filter(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')), lambda x: x NOT IN ('all', 'filter', 'find', 'for', 'give', 'i', 'keep', 'list', 'me', 'need', 'only', 'packets', 'show', 'that', 'the', 'which'))"


@query("few_shot_topk", f"""WITH q AS (SELECT item_id AS query_id, {_CONTENT} AS words FROM benchmark),
    d AS (SELECT doc_id AS example_id, {_CONTENT} AS words FROM documents),
    pr AS (SELECT query_id, example_id, CAST(len(list_intersect(q.words, d.words)) AS BIGINT) AS shared, CAST(len(d.words) AS BIGINT) AS n FROM q, d),
    r AS (SELECT query_id, example_id, shared, n - shared AS extra, CAST(row_number() OVER (PARTITION BY query_id ORDER BY shared DESC, n - shared, example_id) AS INTEGER) AS rank FROM pr)
    SELECT query_id, example_id, shared, extra, rank, CAST(9 - rank AS INTEGER) AS shown FROM r WHERE rank <= 8""")
def few_shot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W3, J7."""
    words = retrieval.content_words(F.col("text"))
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), words.alias("words"))
    d = dealt(table(spark, sf_dir, "documents")).select(F.col("doc_id").alias("id"), words.alias("words"))
    return retrieval.examples(q, d)


_GRAMS = """w AS (SELECT {key}, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM {table}),
    {name} AS (SELECT DISTINCT {key}, unnest([array_to_string(w[i:i + 7], ' ') FOR i IN range(1, len(w) - 6)]) AS gram FROM w)"""
_OVERLAP = "a AS (WITH {} SELECT * FROM g), b AS (WITH {} SELECT * FROM g)".format(_GRAMS.format(key="doc_id", table="documents", name="g"), _GRAMS.format(key="item_id", table="benchmark", name="g"))


@query("ngram_overlap", f"WITH {_OVERLAP} SELECT doc_id, item_id, count(*) AS shared_grams FROM a JOIN b USING (gram) GROUP BY ALL")
def ngram_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F4, A3."""
    return leakage.overlaps(dealt(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"), "doc_id", "item_id")


@query("decontam_gate", f"""WITH {_OVERLAP}, hit AS (SELECT DISTINCT doc_id FROM a JOIN b USING (gram)),
    x AS (SELECT d.doc_id, CASE WHEN d.lang IS NULL THEN 'compile' WHEN row_number() OVER (PARTITION BY d.text ORDER BY d.doc_id) > 1 THEN 'duplicate_key' WHEN l.toxic = 1 THEN 'shortcut'
        WHEN hit.doc_id IS NOT NULL THEN 'dev_test_text' WHEN d.n_chars < 50 THEN 'degenerate' END AS rule FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id LEFT JOIN hit ON hit.doc_id = d.doc_id)
    SELECT rule, count(*) AS n FROM x GROUP BY 1""")
def decontam_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2, A3, W11."""
    d = table(spark, sf_dir, "documents")
    hit = leakage.overlaps(dealt(d), table(spark, sf_dir, "benchmark"), "doc_id", "item_id").select("doc_id").distinct().withColumn("overlaps", F.lit(True))
    toxic = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    marked = leakage.first_seen(d.withColumn("_key", F.sha2(F.col("text").cast("binary"), 256)).drop("text"), ["_key"], ["doc_id"])
    rows = marked.join(hit, "doc_id", "left").join(toxic, "doc_id", "left")
    rule = leakage.drop_rule({"compile": F.col("lang").isNull(), "duplicate_key": F.col("duplicate"), "shortcut": F.col("toxic") == 1, "dev_test_text": F.col("overlaps"), "degenerate": F.col("n_chars") < 50})
    return rows.groupBy(rule.alias("rule")).agg(F.count("*").alias("n"))


@query("first_seen_dedup", "SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1 AS duplicate FROM documents")
def first_seen_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On a digest of the text, so texts are not shuffled."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("_key"))
    return leakage.first_seen(d, ["_key"], ["doc_id"]).select("doc_id", "duplicate")


# Filters that mention a document's number, its label and literals; requests that state some of them.
def _filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("c_custkey")
    host = F.concat(F.lit("198.51.100."), (n % 250).cast("string"))
    parts = [
        F.concat(F.lit("ip.dst == "), host), F.when(n % 3 == 0, F.concat(F.lit("frame.number == "), (n % 9).cast("string"))), F.when(n % 4 == 0, F.lit("tcp.stream eq 1")),
        F.when(n % 5 == 0, F.lit("ip.id == 0x1f")), F.concat(F.lit("tcp.port == "), (41000 + n % 200).cast("string")), F.when(n % 7 == 0, F.lit('dns.qry.name contains "probe-3-4.example"')), F.when(n % 11 == 0, F.lit("ip.src == 10.0.0.0/8")),
        F.when(n % 13 == 0, F.lit("dns.qry.name == Witness-5-6")),
    ]
    request = F.concat(F.lit("Show traffic to "), F.when(n % 2 == 0, host).otherwise("198.51.100.0/24"), F.lit(" port "), (41000 + n % 400).cast("string"), F.lit("."))
    return dealt(table(spark, sf_dir, "customer")).select(n.alias("item_id"), F.array_join(F.array_compact(F.array(*parts)), " && ").alias("filter"), request.alias("request"))


@query("shortcut_scan", """WITH c AS (SELECT c_custkey AS n FROM customer),
    h AS (SELECT n AS item_id, 'capture-position' AS rule, 'frame.number' AS token FROM c WHERE n % 3 = 0 UNION ALL SELECT n, 'capture-position', 'tcp.stream' FROM c WHERE n % 4 = 0
        UNION ALL SELECT n, 'generator-identifier', 'ip.id' FROM c WHERE n % 5 = 0 UNION ALL SELECT n, 'capture-constant', '198.51.100.' || (n % 250) FROM c WHERE n % 2 = 1 AND n % 250 NOT IN (0, 255)
        UNION ALL SELECT n, 'capture-constant', CAST(41000 + n % 200 AS VARCHAR) FROM c WHERE n % 200 <> n % 400 UNION ALL SELECT n, 'capture-constant', 'probe-3-4' FROM c WHERE n % 7 = 0
        UNION ALL SELECT n, 'capture-constant', 'Witness-5-6' FROM c WHERE n % 13 = 0)
    SELECT item_id, rule, token FROM h""")
def shortcut_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B9, E20, F8, F9, J10."""
    rows = _filters(spark, sf_dir).withColumn("refs", filter_text.references(F.col("filter")))
    kinds = F.create_map(F.lit("frame.number"), F.lit("FT_UINT32"), F.lit("ip.dst"), F.lit("FT_IPv4"))
    return rows.select("item_id", F.inline(shortcuts.hits(F.col("refs"), kinds, F.col("request"))))


@query("filter_references", """WITH c AS (SELECT c_custkey AS n FROM customer) SELECT n AS item_id,
    CAST(2 + (n % 3 = 0)::INT + (n % 4 = 0)::INT + (n % 5 = 0)::INT + (n % 7 = 0 OR n % 13 = 0)::INT + (n % 11 = 0)::INT AS INTEGER) AS fields, CAST(1 + (n % 11 = 0)::INT AS INTEGER) AS addresses,
    CAST(1 + (n % 3 = 0)::INT + (n % 4 = 0)::INT + (n % 5 = 0)::INT AS INTEGER) AS numbers, CAST((n % 7 = 0)::INT + (n % 13 = 0)::INT AS INTEGER) AS strings FROM c""")
def filter_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B9."""
    r = filter_text.references(F.col("filter"))
    return _filters(spark, sf_dir).select("item_id", *[F.size(r[k]).alias(k) for k in ("fields", "addresses", "numbers", "strings")])


_WORDS = "list_distinct(regexp_extract_all(lower(p_name), '[a-z0-9]+'))"


@query("error_class", """SELECT doc_id, CASE WHEN len(regexp_extract_all(lower(text), '[a-z0-9]+')) < 50 THEN 'short' WHEN regexp_matches(lower(text), '[0-9]') THEN 'digits' WHEN lang <> 'en' THEN 'other_language' ELSE 'plain' END AS class FROM documents""")
def error_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W10."""
    rules = [("short", F.size(text.ascii_words(F.col("text"))) < 50), ("digits", F.col("text").rlike("[0-9]")), ("other_language", F.col("lang") != "en")]
    return table(spark, sf_dir, "documents").select("doc_id", classes.first_class(rules, "plain").alias("class"))


def _sets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = table(spark, sf_dir, "part").select("p_partkey", F.array(F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2)), F.lower("p_brand"), F.lower("p_type"), (F.col("p_size") % 5).cast("string")).alias("items"))
    words = table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.min("p_partkey").alias("target"), F.min(F.split_part("p_name", F.lit(" "), F.lit(2))).alias("w"))
    # answers without any word of a target: of those sizes alone
    answers = p.select(F.col("p_partkey").alias("answer"), F.when(F.col("p_partkey") % 7 == 0, F.array(F.lit("nowhere"), F.col("p_partkey").cast("string"))).otherwise(F.col("items")).alias("items"))
    return answers, words.select("target", F.array(F.lower("p_brand"), F.lower("p_type"), F.col("w")).alias("items"))


_SETS = """p AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 7 = 0 THEN ['nowhere', CAST(p_partkey AS VARCHAR)] ELSE list_distinct([split_part(p_name, ' ', 1), split_part(p_name, ' ', 2), lower(p_brand), lower(p_type), CAST(p_size % 5 AS VARCHAR)]) END AS items FROM part),
    t AS (SELECT min(p_partkey) AS k, list_distinct([lower(p_brand), lower(p_type), min(split_part(p_name, ' ', 2))]) AS items FROM part GROUP BY p_brand, p_type),
    x AS (SELECT a.k AS answer, t.k AS target, len(list_intersect(a.items, t.items)) AS shared, len(a.items) + len(t.items) - 2 * len(list_intersect(a.items, t.items)) AS apart FROM p a, t)"""


@query("nearest_target", f"WITH {_SETS}, r AS (SELECT *, row_number() OVER (PARTITION BY answer ORDER BY shared DESC, apart, target) AS rn FROM x) SELECT answer, target, CAST(shared AS BIGINT) AS shared, CAST(apart AS BIGINT) AS apart FROM r WHERE rn = 1")
def nearest_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W9."""
    a, t = _sets(spark, sf_dir)
    out = classes.nearest(a, t, "answer", "target", "items")
    return out.withColumns({c: F.col(c).cast("long") for c in ("shared", "apart")})


@query("proximity", """WITH p AS (SELECT p_partkey, regexp_extract_all(lower(p_name), '[a-z]+') AS a, regexp_extract_all(lower(CASE WHEN p_partkey % 3 = 0 THEN p_type || ' ring' ELSE p_name || ' ' || p_type END), '[a-z]+') AS b FROM part)
    SELECT p_partkey, CAST(len(list_distinct(list_concat(a, b))) - len(list_intersect(list_distinct(a), list_distinct(b))) AS INTEGER) AS apart, list_has_all(b, a) AS inside, list_has_all(b, a) AND NOT list_has_all(a, b) AS proper FROM p""")
def proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J8, U5, U7."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), F.lit(0)))
    a, b = words(F.col("p_name")), words(F.when(F.col("p_partkey") % 3 == 0, F.concat_ws(" ", "p_type", F.lit("ring"))).otherwise(F.concat_ws(" ", "p_name", "p_type")))
    return table(spark, sf_dir, "part").select("p_partkey", classes.symmetric_difference(a, b).alias("apart"), classes.contained(a, b).alias("inside"), (classes.contained(a, b) & ~classes.contained(b, a)).alias("proper"))


@query("value_reuse", """WITH s AS (SELECT doc_id AS item_id, lang, source FROM documents), a AS (SELECT doc_id + 1 AS item_id, lang, source FROM documents)
    SELECT DISTINCT a.item_id FROM a JOIN s ON a.item_id = s.item_id AND (a.lang = s.lang OR a.source = s.source)""")
def value_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's values shown, the next one's answered."""
    d = table(spark, sf_dir, "documents")
    cells = F.array(*[F.struct(F.lit(c).alias("field"), classes.value_key(F.col(c), F.lit("string")).alias("value")) for c in ("lang", "source")])
    return classes.reused(d.select(F.col("doc_id").alias("item_id"), F.inline(cells)), d.select((F.col("doc_id") + 1).alias("item_id"), F.inline(cells)))


@query("copy_share", """WITH d AS (SELECT doc_id, lang, md5(text) AS k, list_distinct(regexp_extract_all(text, '[a-z]+')) AS u FROM documents), known AS (SELECT DISTINCT md5(text) AS k FROM benchmark UNION SELECT md5(text) FROM conversations UNION SELECT md5(text) FROM documents WHERE source = 'src0')
    SELECT lang, count(*) AS n, count(*) FILTER (known.k IS NOT NULL) AS copies, count(*) FILTER (len(list_filter(u, lambda x: x NOT IN ('the', 'and', 'of'))) > 0) AS unlisted FROM d LEFT JOIN known USING (k) GROUP BY lang""")
def copy_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The known texts are those of a benchmark, of conversations and of one source."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.md5(F.col("text").cast("binary")).alias("k"), F.array_distinct(F.regexp_extract_all("text", F.lit("[a-z]+"), F.lit(0))).alias("u"))
    known = [table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "conversations"), table(spark, sf_dir, "documents").where("source = 'src0'")]
    keys = [t.select(F.md5(F.col("text").cast("binary")).alias("k")) for t in known]
    return classes.copy_shares(d, keys[0].unionByName(keys[1]).unionByName(keys[2]), "k", ["lang"], F.array(F.lit("the"), F.lit("and"), F.lit("of")), F.col("u"))


@query("status_slots", """SELECT d.doc_id, coalesce(l.quality = 1, FALSE) AS slot_match, coalesce(l.toxic = 0, l.toxic IS NULL AND d.lang IS NULL) AS status_match FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def status_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E9."""
    from packsieve.operators import matching

    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"), "doc_id", "left")
    return d.select("doc_id", matching.slot_match(F.array("quality"), F.array(F.lit(1))).alias("slot_match"), matching.status_match(F.col("toxic"), F.when(F.col("lang").isNotNull(), 0)).alias("status_match"))


@query("gold_coverage", f"""WITH p AS (SELECT p_partkey, {_WORDS} AS g, list_distinct(regexp_extract_all(lower(p_name || ' ' || p_type), '[a-z]+')[2:]) AS s FROM part)
    SELECT p_partkey, CAST(len(g) AS INTEGER) AS gold_fields, CAST(len(s) AS INTEGER) AS shown_fields, CAST(len(list_intersect(g, s)) AS INTEGER) AS shown_gold_fields FROM p""")
def gold_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E10."""
    from packsieve.operators import matching

    both = F.regexp_extract_all(F.lower(F.concat_ws(" ", "p_name", "p_type")), F.lit("[a-z]+"), F.lit(0))
    return table(spark, sf_dir, "part").select("p_partkey", *matching.field_coverage(text.ascii_words(F.col("p_name")), F.slice(both, 2, 9)))


_HALVES = "p_partkey / 8.0"


@query("half_even", f"SELECT p_partkey, round_even({_HALVES}, 2) AS rate, round_even(p_partkey / 2.0, 0) AS whole FROM part")
def half_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    """eighths and halves, which are exact, so every fourth or second one is a tie."""
    from packsieve.operators import rates

    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", rates.half_even(k / 8, 2).alias("rate"), rates.half_even(k / 2, 0).alias("whole"))


@query("request_limits", """SELECT o_orderkey, CASE WHEN o_orderkey % 140 = 0 OR o_orderkey % 140 > 128 THEN 'too_many_items' WHEN o_orderkey % 40 NOT BETWEEN 1 AND 32 THEN 'top_k_out_of_range' WHEN o_custkey * 64 > 32768 THEN 'context_too_large' END AS code FROM orders""")
def request_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Limits of whole requests."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", retrieval.request_code(k % 140, k % 40, F.col("o_custkey") * 64).alias("code"))


# Text functions, on parts, documents and numbers.
@query("tokens", """SELECT doc_id, CAST(len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS INTEGER) AS unicode, CAST(len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS INTEGER) AS words,
    CAST(len(regexp_extract_all(lower(text), '[a-z0-9]+(?:[._-][a-z0-9]+)*')) AS INTEGER) AS lexemes FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)""")
def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1-F3, on whole texts of four languages; a null text has none."""
    d = table(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    return d.select("doc_id", F.size(text.unicode_words(F.col("text"))).alias("unicode"), F.size(text.ascii_words(F.col("text"))).alias("words"), F.size(text.lexemes(F.col("text"))).alias("lexemes"))


@query("acronyms", "SELECT p_partkey, p_name[1:1] || split_part(p_name, ' ', 2)[1:1] || lower(p_brand)[1:1] || regexp_extract(p_brand, '[0-9]+') AS acronym FROM part")
def acronyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F5."""
    return table(spark, sf_dir, "part").select("p_partkey", text.initials(text.unicode_words(F.concat_ws(" ", "p_name", "p_brand"))).alias("acronym"))


@query("stem_ies", "SELECT n_nationkey, n_name, CASE WHEN n_nationkey % 2 = 0 THEN lower(n_name) || 'y' ELSE 'ties' END AS singular FROM nation")
def stem_ies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F6."""
    word = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lower("n_name"), F.lit("ies"))).otherwise("ties")
    return table(spark, sf_dir, "nation").select("n_nationkey", "n_name", text.singular(word).alias("singular"))


@query("subsequence", """WITH t AS (SELECT unnest(['wdg', 'gea', 'sml', 'smal', 'wi', 'bolt', 'blt']) AS token), w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part)
    SELECT token, word FROM t, w WHERE length(token) >= 3 AND length(token) < length(word) AND regexp_matches(word, '^' || array_to_string(string_split(token, ''), '.*'))""")
def subsequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Meets on the first letter."""
    first = lambda c: F.substring(c, 1, 1)
    w = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("word")).distinct().withColumn("i", first("word"))
    t = spark.createDataFrame([(x,) for x in ("wdg", "gea", "sml", "smal", "wi", "bolt", "blt")], "token string").withColumn("i", first("token"))
    return t.join(w, "i").where(text.abbreviates(F.col("token"), F.col("word"))).select("token", "word")


@query("int_literals", "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_custkey WHEN 1 THEN c_custkey WHEN 2 THEN c_custkey ELSE 5 END AS value FROM customer")
def int_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hexadecimal, octal, decimal and binary spellings."""
    n = F.col("c_custkey")
    spelled = F.when(n % 4 == 0, F.concat(F.lit("0x"), F.lower(F.hex(n)))).when(n % 4 == 1, F.concat(F.lit("0"), F.conv(n.cast("string"), 10, 8))).when(n % 4 == 2, n.cast("string")).otherwise("0b101")
    return table(spark, sf_dir, "customer").select("c_custkey", text.integer_literal(spelled).alias("value"))


@query("flag_names", """SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_size & 1 > 0 THEN 'fin' END, CASE WHEN p_size & 2 > 0 THEN 'syn' END, CASE WHEN p_size & 4 > 0 THEN 'reset' END, CASE WHEN p_size & 8 > 0 THEN 'push' END,
    CASE WHEN p_size & 16 > 0 THEN 'ack' END, CASE WHEN p_size & 32 > 0 THEN 'urg' END], lambda x: x IS NOT NULL), ',') AS flags, p_size AS word FROM part""")
def flag_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F12, there and back."""
    names = text.flag_names(F.col("p_size"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(names, ",").alias("flags"), text.flag_word(names).alias("word"))


@query("utf8_bytes", "SELECT doc_id, CAST(strlen(text) AS INTEGER) AS bytes, strlen(text) > 100 AS cut FROM documents")
def utf8_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bytes, and whether a cut at 100 bytes took something off; a cut text is at most three bytes short."""
    cut = text.cut_bytes(F.col("text"), 100)
    took = (F.octet_length(cut) < F.octet_length("text")) & (F.octet_length(cut) >= 97) & F.col("text").startswith(cut)
    return table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").alias("bytes"), took.alias("cut"))


@query("verdict_regex", "SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN event_type END AS verdict FROM events")
def verdict_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F19."""
    return table(spark, sf_dir, "events").select("event_id", text.leading_verdict(F.concat(F.lit(" "), F.col("event_type"), F.lit(": because")), ["view", "click"]).alias("verdict"))


@query("score_int", "SELECT p_partkey, CAST(CASE WHEN p_size % 7 = 0 THEN 0 ELSE (p_size % 7) * 1000 // (2 + p_partkey % 5) + CASE WHEN p_partkey % 10 = 0 THEN 1000000000 ELSE 0 END END AS BIGINT) AS score FROM part")
def score_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F24."""
    return table(spark, sf_dir, "part").select("p_partkey", text.lexical_score(F.col("p_size") % 7, F.col("p_partkey") % 5, F.col("p_partkey") % 10 == 0).alias("score"))


@query("field_names", """WITH n AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN replace(p_name, ' ', '.') WHEN 1 THEN replace(p_name, ' ', '..') WHEN 2 THEN p_name ELSE replace(p_name, ' ', '.') || repeat('x', 256) END AS name FROM part)
    SELECT p_partkey, regexp_full_match(name, '[A-Za-z0-9_-]+(\\.[A-Za-z0-9_-]+)*') AND strlen(name) <= 256 AS ok FROM n""")
def field_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """names with a space, two dots in a row, too many bytes or none of these."""
    k, dotted = F.col("p_partkey") % 4, F.regexp_replace("p_name", " ", ".")
    name = F.when(k == 0, dotted).when(k == 1, F.regexp_replace("p_name", " ", "..")).when(k == 2, F.col("p_name")).otherwise(F.concat(dotted, F.repeat(F.lit("x"), 256)))
    return table(spark, sf_dir, "part").select("p_partkey", text.is_field_name(name).alias("ok"))


@query("json_pointer", """SELECT event_id, json_extract_string(props, '$.k') AS k, sha256(props) AS digest, CAST(json_array_length(list) AS BIGINT) AS n, list_sum(CAST(from_json(list, '["DOUBLE"]') AS DOUBLE[])) AS total, len(json_keys(twice)) > len(list_distinct(json_keys(twice))) AS repeats
    FROM (SELECT event_id, props, '[1, ' || json_extract_string(props, '$.k') || CASE WHEN event_id % 2 = 0 THEN ', 2.5]' ELSE ']' END AS list, CASE WHEN event_id % 3 = 0 THEN replace(props, '}', ', "k": 1}') ELSE props END AS twice FROM events)""")
def json_pointer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F14, F16-F18."""
    doc = F.concat(F.lit('{"a/b": [1, '), F.get_json_object("props", "$.k"), F.when(F.col("event_id") % 2 == 0, ", 2.5]}").otherwise("]}"))
    twice = F.when(F.col("event_id") % 3 == 0, F.replace("props", F.lit("}"), F.lit(', "k": 1}'))).otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select(
        "event_id", jsons.pointer(F.col("props"), "/k").alias("k"), jsons.digest(F.col("props")).alias("digest"), jsons.length(doc, "/a~1b").alias("n"), jsons.total(doc, "/a~1b").alias("total"), jsons.repeats_a_key(twice).alias("repeats")
    )


@query("canonical_digest", """SELECT o_orderkey, sha256('{"key":' || o_orderkey || ',"note":null,"status":"' || o_orderstatus || '"}') AS digest FROM orders""")
def canonical_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F14, K1."""
    from packsieve.sources.sinks import canonical_json

    rows = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("key"), F.lit(None).cast("string").alias("note"))
    return rows.select(F.col("key").alias("o_orderkey"), jsons.digest(canonical_json(rows)).alias("digest"))


@query("subnet_filter", """WITH c AS (SELECT c_custkey, 167772160 + c_custkey * 4099 % 1048576 AS n FROM customer)
    SELECT c_custkey, '10.' || (n // 65536 % 256) || '.' || (n // 256 % 256) || '.' || (n % 256) AS addr, n // 4096 * 4096 AS net, n // 4096 * 4096 + 4095 AS last, n // 4096 * 4096 + 256 AS sub FROM c WHERE n BETWEEN 167772160 AND 167772160 + 262143""")
def subnet_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10, F10."""
    n = F.lit(167772160) + F.col("c_custkey") * 4099 % 1048576
    rows = table(spark, sf_dir, "customer").select("c_custkey", networks.dotted(n).alias("addr")).withColumn("n", networks.address(F.col("addr")))
    p = F.lit(20)
    return rows.where(networks.contains(F.lit(167772160), networks.last(F.lit(167772160), F.lit(14)), F.col("n"))).select(
        "c_custkey", "addr", networks.first(F.col("n"), p).alias("net"), networks.last(F.col("n"), p).alias("last"), networks.subnet(F.col("n"), p, F.lit(24), F.lit(1)).alias("sub")
    )


@query("range_overlap", """WITH s AS (SELECT s_suppkey, s_suppkey * 100 % 5000 AS lo, s_suppkey * 100 % 5000 + s_suppkey * 7 % 300 AS hi FROM supplier) SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM s a JOIN s b ON a.s_suppkey < b.s_suppkey AND a.lo <= b.hi AND b.lo <= a.hi""")
def range_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J10."""
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier").select(k, (k * 100 % 5000).alias("lo"), (k * 100 % 5000 + k * 7 % 300).alias("hi"))
    return networks.overlapping(s, "s_suppkey", "lo", "hi", 512)


@query("stated_networks", "SELECT c_custkey, 167772160 + c_custkey % 256 * 65536 AS lo, 167772160 + c_custkey % 256 * 65536 + 65535 AS hi FROM customer")
def stated_networks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F9."""
    request = F.concat(F.lit("traffic of 10."), (F.col("c_custkey") % 256).cast("string"), F.lit("/16, please"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.inline(networks.stated(request)))
