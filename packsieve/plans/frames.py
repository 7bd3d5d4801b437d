"""The driver's tables as frames with typed fields, and the same in SQL.

A probe is an event type, a frame an event. Documents with their labels give
fields that are absent, since labels cover some of the documents only.
"""

from __future__ import annotations

import ipaddress

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packsieve.operators.predicates import Both, Field, Leaf, Neither, Tree, children


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame) -> DataFrame:
    """A scanned table dealt out anew if it has fewer partitions than there are cores: small files often come as one task. Large tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < cores else df


EVENTS = {
    f.name: f
    for f in (
        Field("event.user", "integer", "user_id"), Field("event.k", "integer", "k"), Field("event.value", "float", "value"), Field("event.type", "string", "event_type"),
        Field("event.large", "float", "large"), Field("event.pair", "integer", "pair", many=True), Field("event.addr", "ipv4", "addr"), Field("event.paid", "protocol", "paid"),
        Field("event.blob", "unsupported", "props"),
    )
}
EVENTS_SQL = """
    frames AS (SELECT event_type AS probe_id, event_id AS frame, user_id, value, event_type, ts,
        CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, CASE WHEN value >= 20 THEN value END AS large,
        [user_id, CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) AS BIGINT)] AS pair,
        167772160 + (user_id * 7919 + event_id) % 1048576 AS addr, event_type = 'purchase' AS paid FROM events)"""


def event_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("probe_id"), F.col("event_id").alias("frame"), "user_id", "value", "event_type", "ts", k.alias("k"),
        F.when(F.col("value") >= 20, F.col("value")).alias("large"), F.array(F.col("user_id"), k.cast("long")).alias("pair"),
        (F.lit(167772160) + (F.col("user_id") * 7919 + F.col("event_id")) % 1048576).alias("addr"), (F.col("event_type") == "purchase").alias("paid"),
    )


DOCUMENTS = {
    f.name: f
    for f in (
        Field("doc.quality", "integer", "quality"), Field("doc.toxic", "integer", "toxic"), Field("doc.lang", "string", "lang"), Field("doc.source", "string", "source"),
        Field("doc.chars", "integer", "n_chars"), Field("doc.labelled", "protocol", "labelled"), Field("doc.marks", "integer", "marks", many=True), Field("doc.text", "string", "text"),
    )
}
DOCUMENTS_SQL = """
    frames AS (SELECT d.doc_id AS frame, d.source AS probe_id, d.lang, d.source, d.n_chars, l.quality, l.toxic, l.doc_id IS NOT NULL AS labelled,
        CASE WHEN l.doc_id IS NOT NULL THEN [l.quality, l.toxic] END AS marks, d.text FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def document_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic", F.lit(True).alias("_there"))
    return table(spark, sf_dir, "documents").join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("frame"), F.col("source").alias("probe_id"), "lang", "source", "n_chars", "quality", "toxic", F.coalesce("_there", F.lit(False)).alias("labelled"),
        F.when(F.col("_there"), F.array("quality", "toxic")).alias("marks"), "text",
    )


def sql(tree: Tree, catalog: dict[str, Field]) -> str:
    """The tree as a DuckDB condition that is never null: the oracle of ``columns.column``."""
    if isinstance(tree, Neither):
        return f"(NOT {sql(tree.part, catalog)})"
    if not isinstance(tree, Leaf):
        return "(" + (" AND " if isinstance(tree, Both) else " OR ").join(sql(p, catalog) for p in children(tree)) + ")"
    field = catalog[tree.field]
    col = field.column

    def literal(v: object) -> str:
        if field.kind == "ipv4":
            return str(int(ipaddress.ip_address(v)))
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)

    def test(c: str) -> str:
        if tree.op == "in":
            return f"{c} IN ({', '.join(map(literal, tree.value))})"
        if tree.op == "in_subnet":
            net = ipaddress.ip_network(tree.value, strict=False)
            return f"{c} BETWEEN {int(net.network_address)} AND {int(net.broadcast_address)}"
        if tree.op == "contains":
            return f"contains({c}, {literal(tree.value)})"
        return f"{c} { {'eq': '=', 'ne': '<>', 'lt': '<', 'le': '<=', 'gt': '>', 'ge': '>='}[tree.op]} {literal(tree.value)}"

    if field.kind == "protocol":
        return f"coalesce({col}, FALSE)"
    if tree.op == "exists":
        return f"({col} IS NOT NULL)" if not field.many else f"coalesce(len(list_filter({col}, lambda x: x IS NOT NULL)) > 0, FALSE)"
    if field.many and tree.op == "ne":
        return f"coalesce(len({col}) > 0 AND list_bool_and(list_transform({col}, lambda x: {test('x')})), FALSE)"
    if field.many:
        return f"coalesce(list_bool_or(list_transform({col}, lambda x: {test('x')})), FALSE)"
    return f"coalesce({test(col)}, FALSE)"
