"""Frames from PCAP files (S1, S2, S17, F13, W16) and packet lists (S3).

A capture is a small file; a table of captures is read file by file with Spark's
``binaryFile`` source and decoded inside the tasks, a row per frame. Bytes that
are not what the decoder expects are refused, never guessed.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MOST_BYTES, MOST_FRAMES = 16 << 20, 100_000
DNS_PORTS = (53, 5353)
FRAME = (
    "probe_id string, frame int, ip_src long, ip_dst long, ip_ttl int, ip_dsfield_ecn int, tcp boolean, udp boolean, tcp_srcport int, tcp_dstport int, tcp_flags int, tcp_len int, "
    "tcp_seq long, tcp_ack long, udp_srcport int, udp_dstport int, dns_flags_response boolean, dns_flags_rcode int, dns_qry_type int, error string"
)
NAMES = [c.split()[0] for c in FRAME.split(", ")]
PACKET_LIST = "frame int, time double, source string, destination string, protocol string, length int, info string"


class Unreadable(ValueError):
    """Bytes outside what the decoder reads."""


def need(ok: bool, what: str) -> None:
    if not ok:
        raise Unreadable(what)


def question(message: bytes) -> dict:
    """Header flags and first question of a DNS message."""
    need(len(message) >= 12, "DNS header out of bounds")
    flags, questions = struct.unpack_from("!HH", message, 2)
    out: dict = {"dns_flags_response": bool(flags >> 15)}
    if flags >> 15:
        out["dns_flags_rcode"] = flags & 15
    if questions:
        at, name = 12, 1
        while True:
            need(at < len(message), "DNS name out of bounds")
            n = message[at]
            need(n < 64, "DNS name is compressed")
            at += 1 + n
            name += 1 + n
            if not n:
                break
            need(name <= 255, "DNS name is too long")
        need(at + 4 <= len(message), "DNS question out of bounds")
        out["dns_qry_type"] = struct.unpack_from("!H", message, at)[0]
    return out


def packet(data: bytes, is_dns: bool | None = None) -> dict:
    """The facts of one Ethernet frame with IPv4 and TCP or UDP. ``is_dns``: None tells DNS by its ports."""
    need(len(data) >= 34 and data[12:14] == b"\x08\x00", "not IPv4 over Ethernet")
    ip = data[14:]
    head, total = (ip[0] & 15) * 4, struct.unpack_from("!H", ip, 2)[0]
    need(ip[0] >> 4 == 4 and 20 <= head <= total <= len(ip), "IPv4 header out of bounds")
    need(not struct.unpack_from("!H", ip, 6)[0] & 0x3FFF, "IPv4 fragment")
    src, dst = struct.unpack_from("!II", ip, 12)
    out: dict = {"ip_src": src, "ip_dst": dst, "ip_ttl": ip[8], "ip_dsfield_ecn": ip[1] & 3, "tcp": ip[9] == 6, "udp": ip[9] == 17}
    part = ip[head:total]
    if ip[9] == 6:
        need(len(part) >= 20, "TCP header out of bounds")
        sport, dport, seq, ack, bits = struct.unpack_from("!HHIIH", part)
        body = (bits >> 12) * 4
        need(20 <= body <= len(part), "TCP data offset out of bounds")
        need(not bits & 0xE00, "reserved TCP flags are set")
        payload = part[body:]
        out |= {"tcp_srcport": sport, "tcp_dstport": dport, "tcp_flags": bits & 0x1FF, "tcp_len": len(payload), "tcp_seq": seq, "tcp_ack": ack}
    elif ip[9] == 17:
        need(len(part) >= 8 and struct.unpack_from("!H", part, 4)[0] == len(part), "UDP length out of bounds")
        sport, dport = struct.unpack_from("!HH", part)
        payload = part[8:]
        out |= {"udp_srcport": sport, "udp_dstport": dport}
    else:
        raise Unreadable("neither TCP nor UDP")
    if is_dns or is_dns is None and payload and (sport in DNS_PORTS or dport in DNS_PORTS):
        if ip[9] == 6:
            need(len(payload) >= 2 and struct.unpack_from("!H", payload)[0] == len(payload) - 2, "DNS over TCP length out of bounds")
            payload = payload[2:]
        out |= question(payload)
    return out


def frames_of(data: bytes) -> Iterator[bytes]:
    """The packets of a little-endian Ethernet PCAP 2.4."""
    need(len(data) >= 24 and data[:4] == b"\xd4\xc3\xb2\xa1" and struct.unpack_from("<HH", data, 4) == (2, 4) and struct.unpack_from("<I", data, 20)[0] == 1, "not a little-endian Ethernet PCAP 2.4")
    at, n = 24, 0
    while at < len(data):
        n += 1
        need(n <= MOST_FRAMES, "too many frames")
        need(at + 16 <= len(data), "record header out of bounds")
        kept, original = struct.unpack_from("<II", data, at + 8)
        need(kept == original and at + 16 + kept <= len(data), "record is cut short")
        yield data[at + 16 : at + 16 + kept]
        at += 16 + kept
    need(n > 0, "no frames")


def decode(captures: DataFrame) -> DataFrame:
    """Frames of a table (probe_id, content). A capture that can't be read is one row with ``error`` alone."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for probe, content in zip(batch.probe_id, batch.content, strict=True):
                try:
                    rows = [{"probe_id": probe, "frame": i, **packet(p)} for i, p in enumerate(frames_of(bytes(content)), 1)]
                except Unreadable as e:
                    rows = [{"probe_id": probe, "error": str(e)}]
                out = pd.DataFrame(rows, columns=NAMES).astype({"probe_id": object, "error": object})
                for c in ("ip_src", "ip_dst", "tcp_seq", "tcp_ack"):
                    out[c] = out[c].astype("Int64")
                for c in ("frame", "ip_ttl", "ip_dsfield_ecn", "tcp_srcport", "tcp_dstport", "tcp_flags", "tcp_len", "udp_srcport", "udp_dstport", "dns_flags_rcode", "dns_qry_type"):
                    out[c] = out[c].astype("Int32")
                for c in ("tcp", "udp", "dns_flags_response"):
                    out[c] = out[c].astype("boolean")
                yield out

    return captures.select("probe_id", "content").mapInPandas(run, FRAME)


def files(spark: SparkSession, path: str, digests: DataFrame | None = None, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(probe_id, content, sha256, code) of capture files; oversized or changed files get a code and no content.

    ``digests``: probe_id, sha256 as recorded. The content of a file that is too long is never loaded.
    """
    name = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    found = spark.read.format("binaryFile").load(path).where(F.col("length") <= most_bytes).select(name.alias("probe_id"), "content", F.sha2("content", 256).alias("sha256"))
    large = spark.read.format("binaryFile").load(path).where(F.col("length") > most_bytes).select(name.alias("probe_id"), F.lit(None).cast("binary").alias("content"), F.lit(None).cast("string").alias("sha256"))
    rows = found.unionByName(large)
    if digests is None:
        return rows.withColumn("code", F.when(F.col("content").isNull(), "too_long"))
    known = digests.select("probe_id", F.col("sha256").alias("_recorded"))
    code = F.when(F.col("content").isNull(), "too_long").when(~F.col("sha256").eqNullSafe(F.col("_recorded")), "changed")
    return rows.join(known, "probe_id", "left").withColumn("code", code).withColumn("content", F.when(code.isNull(), F.col("content"))).drop("_recorded")


def widened(frames: DataFrame) -> DataFrame:
    """Adds the columns that predicates ask for: both-direction arrays, flags by name, relative numbers."""
    from packsieve.functions.text import TCP_FLAGS

    either = lambda a, b: F.when(F.col(a).isNotNull(), F.array(a, b))
    flags = {f"tcp_flags_{n}": F.getbit(F.col("tcp_flags").cast("long"), F.lit(i)) == 1 for i, n in enumerate(TCP_FLAGS[:8])}
    out = frames.withColumns({"ip_addr": either("ip_src", "ip_dst"), "tcp_port": either("tcp_srcport", "tcp_dstport"), "udp_port": either("udp_srcport", "udp_dstport"), "dns": F.col("dns_flags_response").isNotNull(), **flags})
    return relative(out)


def relative(frames: DataFrame, probe: str = "probe_id", frame: str = "frame") -> DataFrame:
    """Sequence and acknowledgment numbers relative to the first of their stream and direction.

    The first frame of a direction sets its base; an acknowledgment seen before the
    other direction's first frame sets that one's base, less one.
    """
    a, b = (F.struct(F.col(ip).alias("ip"), F.col(port).alias("port")) for ip, port in (("ip_src", "tcp_srcport"), ("ip_dst", "tcp_dstport")))
    other = Window.partitionBy(probe, F.least(a, b), F.greatest(a, b)).orderBy(frame)
    acks = F.getbit(F.coalesce("tcp_flags", F.lit(0)).cast("long"), F.lit(4)) == 1
    forward = F.first(F.when(a < b, F.col("tcp_seq")).when(acks, F.col("tcp_ack") - 1), ignorenulls=True).over(other)
    back = F.first(F.when(a >= b, F.col("tcp_seq")).when(acks, F.col("tcp_ack") - 1), ignorenulls=True).over(other)
    return frames.withColumns({
        "tcp_rel_seq": F.when(F.col("tcp"), F.col("tcp_seq") - F.when(a < b, forward).otherwise(back)),
        "tcp_rel_ack": F.when(F.col("tcp"), F.when(acks, F.col("tcp_ack") - F.when(a < b, back).otherwise(forward)).otherwise(0)),
    })


def appended(frames: DataFrame, tail: DataFrame, probe: str = "probe_id", frame: str = "frame") -> DataFrame:
    """The tail's frames after each probe's own, numbered on; the prefix is unchanged."""
    last = frames.groupBy(probe).agg(F.max(frame).alias("_n"))
    return frames.unionByName(tail.join(last, probe).withColumn(frame, (F.col(frame) + F.col("_n")).cast(frames.schema[frame].dataType)).drop("_n"), allowMissingColumns=True)


def labels(frames: DataFrame, case_recipes: DataFrame, case: str = "case_id", recipe: str = "recipe", keys: Sequence[str] = ("probe_id", "frame")) -> DataFrame:
    """(case, keys) of the frames whose recipe belongs to the case: membership alone, never a filter."""
    return frames.select(*keys, recipe).join(case_recipes.select(case, recipe).distinct(), recipe).select(case, *keys)


def packet_list(spark: SparkSession, path: str) -> DataFrame:
    """S3: seven display columns per frame of a tab-separated list; another number of columns fails the read."""
    return spark.read.schema(PACKET_LIST).option("sep", "\t").option("mode", "FAILFAST").csv(path)


def misnumbered(rows: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """S3: groups whose frames are not 1..n, each once."""
    return rows.groupBy(*group).agg(F.count("*").alias("n"), F.min("frame").alias("first"), F.max("frame").alias("last"), F.count_distinct("frame").alias("distinct")).where(
        "first <> 1 or last <> n or distinct <> n"
    )
