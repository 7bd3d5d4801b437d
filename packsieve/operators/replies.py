"""Replies as columns: the envelope of either contract, read strictly in the JVM.

Nothing is cut out of prose or repaired. A reply is one JSON object of at most 64 KiB
whose members are known, told once and of their type; which members may stand
together follows from the status. The tree inside a typed reply is read by
``tree_rows``.

Spark's JSON readers stop at the end of the first value. So the reply is read as a
member of an object whose other member is the reply's own digest: only where the
whole reply is one value are both there.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from packsieve.operators.predicates import REPLY_BYTES, SLOTS

# Statuses, members of an envelope, versions and payloads by contract, bytes of a filter.
STATUSES = ("ready", "needs_clarification", "not_expressible")
MEMBERS = ("schema_version", "status", "assumptions", "clarifying_question", "missing_slots")
CONTRACTS = {"typed_ir": ("1.0", "intent_ir"), "display_filter": ("direct-filter/1.0", "display_filter")}
FILTER_BYTES = 4096


def parsed(reply: Column, contract: str) -> Column:
    """A struct: code (``malformed`` or null), status, question, missing, assumptions, payload (text); all but the code are null where it is not.

    ``contract``: ``typed_ir`` or ``display_filter``. A null reply is malformed.
    """
    version, payload = CONTRACTS[contract]
    digest = F.sha2(reply.cast("binary"), 256)
    wrapped = F.concat(F.lit('{"r":'), reply, F.lit(',"z":"'), digest, F.lit('"}'))
    v = F.when(F.octet_length(reply) <= REPLY_BYTES, F.try_parse_json(wrapped))  # null for repeated members too
    keys = F.json_object_keys(reply)
    kind = lambda name: F.coalesce(F.schema_of_variant(F.try_variant_get(v, f"$.r.{name}", "variant")), F.lit("VOID"))
    held = lambda name: F.array_contains(keys, name)
    text = lambda name: F.try_variant_get(v, f"$.r.{name}", "string")
    texts = lambda name: F.coalesce(F.try_variant_get(v, f"$.r.{name}", "array<string>"), F.array().cast("array<string>"))
    is_list = lambda name: ~held(name) | kind(name).isin("ARRAY<STRING>", "ARRAY<VOID>") & ~F.exists(F.coalesce(F.try_variant_get(v, f"$.r.{name}", "array<string>"), F.array(F.lit(None).cast("string"))), F.isnull)
    status, question, missing = text("status"), text("clarifying_question"), texts("missing_slots")
    body = text(payload) if contract == "display_filter" else F.get_json_object(reply, f"$.{payload}")
    has = kind(payload) != "VOID"
    asks = kind("clarifying_question") != "VOID"
    if contract == "display_filter":
        fits = (kind(payload) == "STRING") & (F.trim(F.regexp_replace(body, r"(?U)\s", " ")) != "") & (F.octet_length(body) <= FILTER_BYTES) & ~body.rlike(r"[\x00-\x1F]")
    else:
        fits = kind(payload).startswith("OBJECT")
    ok = (
        (F.try_variant_get(v, "$.z", "string") == digest)
        & (F.array_join(F.json_object_keys(wrapped), ",") == "r,z")
        & F.coalesce(F.schema_of_variant(F.try_variant_get(v, "$.r", "variant")).startswith("OBJECT"), F.lit(False))
        & (F.size(F.array_except(keys, F.array(*map(F.lit, (*MEMBERS, payload))))) == 0)
        & (~held("schema_version") | (kind("schema_version") == "STRING") & (text("schema_version") == version))
        & (kind("status") == "STRING") & status.isin(*STATUSES)
        & is_list("assumptions") & is_list("missing_slots")
        & (F.size(F.array_except(missing, F.array(*map(F.lit, SLOTS)))) == 0) & (F.size(F.array_distinct(missing)) == F.size(missing))
        & kind("clarifying_question").isin("STRING", "VOID") & (~has | fits)
        & ((status == "needs_clarification") | (F.size(missing) == 0))
        & F.when(status == "ready", has & ~asks).when(status == "needs_clarification", asks & (F.length(question) > 0) & ~has).otherwise(~has & ~asks)
    )
    ok = F.coalesce(ok, F.lit(False))
    only = lambda c, name: F.when(ok, c).alias(name)
    return F.struct(
        F.when(~ok, "malformed").alias("code"), only(status, "status"), only(question, "question"), only(missing, "missing"), only(texts("assumptions"), "assumptions"), only(F.when(has, body), "payload")
    )
