"""Shortcuts: what a filter mentions that only the capture, not the request, could tell it.

References come from ``filter_text.references``; here they are judged against the
request's text, whose stated literals are never shortcuts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from packsieve.functions import networks, text
from packsieve.operators.filter_text import GENERATED_NAME, IPV4

# Field types that count frames or time, fields of the frame that describe the packet, derived state.
POSITION_TYPES = ("FT_FRAMENUM", "FT_ABSOLUTE_TIME", "FT_RELATIVE_TIME")
PACKET_FRAME_FIELDS = ("frame.len", "frame.cap_len", "frame.protocols")
STATE_FIELDS, STATE_PREFIXES = ("dns.unsolicited",), ("tcp.analysis", "tcp.completeness", "dns.retransmi")
GENERATOR_FIELDS = ("ip.id", "dns.id", "tcp.seq_raw", "tcp.ack_raw")
# The generated captures' servers, clients and ephemeral ports.
SERVERS, CLIENTS = ("198.51.100.0", 24), ("192.0.2.0", 24)
EPHEMERAL = (41000, 51254)
NAMED_NETWORKS = (("test-net-1", "192.0.2.0", 24), ("test-net-2", "198.51.100.0", 24), ("test-net-3", "203.0.113.0", 24))
RULES = ("capture-position", "generator-identifier", "capture-constant")


def number(dotted: str) -> int:
    a, b, c, d = map(int, dotted.split("."))
    return ((a * 256 + b) * 256 + c) * 256 + d


def is_position(name: Column, kind: Column) -> Column:
    """A field that tells where in the capture a packet is."""
    prefix = F.lit(False)
    for p in STATE_PREFIXES:
        prefix = prefix | name.startswith(p)
    parts = F.split(name, r"\.")
    return (
        F.coalesce(kind.isin(*POSITION_TYPES), F.lit(False)) | name.startswith("_ws.") | name.isin(*STATE_FIELDS) | prefix
        | (name.startswith("frame.") & ~name.isin(*PACKET_FRAME_FIELDS)) | F.array_contains(parts, "stream")
    )


def is_generator(name: Column) -> Column:
    """A field that identifies the packet, not what it does."""
    return name.isin(*GENERATOR_FIELDS) | F.exists(F.split(name, r"\."), lambda p: p.startswith("checksum"))


def stated_networks(request: Column) -> Column:
    """(lo, hi) of the networks that a request states by prefix, in shorthand, or by name."""
    named = [
        F.when(F.lower(request).contains(n), F.struct(F.lit(number(a)).cast("long").alias("lo"), F.lit(number(a) + (1 << 32 - p) - 1).cast("long").alias("hi")))
        for n, a, p in NAMED_NETWORKS
    ]
    return F.concat(networks.stated(request), F.filter(F.array(*named), lambda s: s.isNotNull()))


def address_hit(word: Column, request: Column, stated: Column) -> Column:
    """An address or network of the filter that the request does not state.

    Hosts always count; networks count where they hold servers of the capture and
    none of its clients. A host is stated as the first or last of a stated network,
    a network inside one.
    """
    prefix = F.coalesce(F.split_part(word, F.lit("/"), F.lit(2)).try_cast("int"), F.lit(32))
    n = networks.address(F.split_part(word, F.lit("/"), F.lit(1)))
    lo, hi = networks.first(n, prefix), networks.last(n, prefix)
    inside = lambda net: networks.overlaps(lo, hi, F.lit(number(net[0])), F.lit(number(net[0]) + (1 << 32 - net[1]) - 1))
    picks = inside(SERVERS) & ~inside(CLIENTS)
    told = text.mentions(request, word) | text.mentions(request, networks.dotted(lo))
    told = told | F.exists(stated, lambda s: F.when(prefix == 32, (lo == s["lo"]) | (lo == s["hi"])).otherwise((lo >= s["lo"]) & (hi <= s["hi"])))
    return F.coalesce(n.isNotNull() & (prefix <= 32) & ((prefix == 32) | picks) & ~told, F.lit(False))


def number_hit(word: Column, request: Column) -> Column:
    value = text.integer_literal(word)
    return F.coalesce(value.between(*EPHEMERAL) & ~text.mentions(request, word) & ~text.mentions(request, value.cast("string")), F.lit(False))


def hits(references: Column, kinds: Column, request: Column, most_chars: int = 64) -> Column:
    """Array of (rule, token), each once, in the rules' order. ``kinds``: map of field name to raw type."""
    stated = stated_networks(request)
    entry = lambda rule: lambda w: F.struct(F.lit(rule).alias("rule"), F.substr(w, F.lit(1), F.lit(most_chars)).alias("token"))
    kind = lambda w: F.try_element_at(kinds, w)
    position = F.filter(references["fields"], lambda w: is_position(w, kind(w)))
    generator = F.filter(references["fields"], lambda w: ~is_position(w, kind(w)) & is_generator(w))
    addresses = F.filter(references["addresses"], lambda w: w.rlike(f"^(?:{IPV4})$") & address_hit(w, request, stated))
    numbers = F.filter(references["numbers"], lambda w: number_hit(w, request))
    macs = F.filter(references["macs"], lambda w: ~text.mentions(request, w))
    names = F.filter(F.flatten(F.transform(references["strings"], lambda s: F.regexp_extract_all(s, F.lit(GENERATED_NAME), F.lit(1)))), lambda w: ~text.mentions(request, w))
    return F.array_distinct(
        F.concat(
            F.transform(position, entry(RULES[0])), F.transform(generator, entry(RULES[1])),
            *[F.transform(x, entry(RULES[2])) for x in (addresses, numbers, macs, names)],
        )
    )
