"""Operator 6: SimHash near-duplicates, linked through Golay-code keys.

Fingerprints. A text's words (ASCII white space apart, A-Z lowered) form
shingles; each of 64 bits is set if over half of the shingles' XXH64 have it.

Links. Fingerprints with at most 4 differing bits are linked. A fingerprint is
cut into three segments of 22, 21 and 21 bits. The perfect binary Golay code
[23,12,7] maps any 23 bits to the index of the one codeword within 3 errors;
``near`` of a segment are the indices of itself and of all one-bit changes (at
most 6, since a word at distance 3 has five codewords at distance 4). Segments
that differ in two bits share one of those: the index of the word halfway.

With at most 4 errors one of these holds:
* a segment i is equal, and of the other two one, j, has at most 2 errors: both
  fingerprints get the keys (i, j, segment i, index in near(j));
* no segment is equal; then two, i and j, have exactly 1 error: the first gets
  the keys (i, j, index in near(i), index of j), the second (i, j, index of i,
  index in near(j)).
The keys are joined and every candidate is verified by its exact distance, in
the join's condition; the condition also picks one of the ways by which a pair
is found, so pairs don't repeat.

Large groups. Equal fingerprints are one row. Before the join, fingerprints that
agree in two segments are linked to the smallest of them (a star, not pairs), and
the join then skips pairs that the stars already connect.

Similar texts. Links of 4 bits are rare at a similarity of 0.8, so ``cluster`` also
links texts that share this much of their five-word shingles, each counted once.
A wider print of 184 bits, eight segments of 23, is made of pairs of neighbouring shingle
hashes; with each segment go the two least values of these under two other hashes. A
print's keys are a Golay index near a segment, together with that segment's two least
values: a pair at 0.8 shares an index near a given segment in 61 of 100 cases, both least
values in 64, and so one of the eight kinds of key in 98. Keys have 64 bits, so texts that
share none of this hardly meet in tables of any size. Of texts that meet
under a key those whose whole prints differ in at most ``APART`` bits are compared by all their
shingles: a pair at 0.8 does but for one in ten thousand, texts that share a passage alone don't. First each text is compared with one other, the smallest under
any of its keys, so a crowd becomes one component in as many comparisons as it has texts; then,
of what is still in different components, each key's texts with its smallest, and in the end those
that meet under a key with one another: all of them where a key has at most ``FEW`` texts, else as a crowd.

Crowds. Hundreds of edited copies of one text meet under each other's keys, though few pairs share 0.8. A crowd
is the texts of full keys with the same two least values. Its shingles held by over half of its texts are common to it; a text
A is then its difference D(A) from those, what it has besides and what it lacks. Two texts share 0.8 if
|D(A)| + |D(B)| - 2 |D(A) and D(B)| is at most a ninth of |A| + |B|, that is if they have (x(A) + x(B)) / 2 differences
in common, with x(A) = |D(A)| - |A| / 9. Texts that need none in common with the one of the least x are linked to
it. A pair with one of the others needs a difference in common, and it is found, exactly, as in prefix filtering: differences
are put in order, rarest first, and two texts are compared where they share one behind which, itself included, both have as many as they need.

Edge cases: null or wordless text has fingerprint zero and is linked like any
other; fewer words than a shingle are one shingle; null doc_ids are linked but
never name a component unless all of it are null; repeated rows give repeated
rows; an empty table gives no rows; extra columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packsieve.llm import scratch
from packsieve.llm.components import components
from packsieve.llm.exact_dedup import BROADCAST_KEYS, without

WORDS, SEED, DISTANCE, SALTS = 4, 42, 4, 8
WIDTHS = (22, 21, 21)
SHIFTS = (42, 21, 0)
#: Shared part of the five-word shingles of texts that ``cluster`` links, and the bits in which the prints (of 192) of such texts may differ: 29 by the error rate, and four deviations.
SIMILARITY, APART = 0.8, 52
#: Texts under one key up to which all are compared with one another, so that a row makes fewer pairs than this.
FEW = 8
#: Odd multipliers that make three hashes of two neighbouring ones.
PRINT_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
PRINT, LEAST = ("w0", "w1", "w2"), tuple(f"m{g}" for g in range(8))
#: Odd multipliers of the hashes of which the least values are taken, two for each segment.
ORDERS = np.array([(PRINT_MIX[0] * (2 * i + 1) ^ PRINT_MIX[2] << i) % (1 << 64) | 1 for i in range(2 * len(LEAST))], dtype=np.uint64)
GENERATOR = 0b110001110101  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """The XXH64 of each shingle of a whole text, repeats included."""
    import xxhash

    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.zeros(0, dtype="<u8")
    line = b" ".join(w)
    ends = np.cumsum([len(x) + 1 for x in w]) - 1
    k = min(words, len(w))
    starts = np.concatenate([[0], ends[: len(w) - k] + 1]).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[s:e], SEED) for s, e in zip(starts, ends[k - 1 :].tolist(), strict=True)], dtype="<u8")


def longer(h: np.ndarray, mix: int = PRINT_MIX[0]) -> np.ndarray:
    """Hashes of shingles one word longer: of each shingle and the next, or of the only one."""
    a, b = (h[:-1], h[1:]) if len(h) > 1 else (h, h)
    x = a * np.uint64(mix) ^ (b >> np.uint64(32) | b << np.uint64(32))
    for shift in (29, 32):
        x = (x ^ x >> np.uint64(shift)) * np.uint64(PRINT_MIX[1])
    return x ^ x >> np.uint64(31)


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One hash of two numbers."""
    x = (a ^ a >> np.uint64(29)) * np.uint64(PRINT_MIX[1]) ^ b * np.uint64(PRINT_MIX[0])
    x = (x ^ x >> np.uint64(32)) * np.uint64(PRINT_MIX[2])
    return x ^ x >> np.uint64(31)


def least_values(h: np.ndarray) -> np.ndarray:
    """For each segment a hash of the two least values of its two orders; of no hashes, that of zeros."""
    if not len(h):
        return np.zeros(len(LEAST), dtype=np.uint64)
    least = np.array([(h * m).min() for m in ORDERS], dtype=np.uint64).reshape(-1, 2)
    return mixed(mixed(least[:, 0], least[:, 1]), np.arange(len(LEAST), dtype=np.uint64))


def majority(h: np.ndarray) -> np.ndarray:
    """Of each column of 64-bit hashes the number whose bits are those set in over half of its rows."""
    columns = h.shape[1]
    bits = np.unpackbits(np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8 * columns), axis=1, bitorder="little")
    count = np.zeros(64 * columns, dtype=np.int64)
    for at in range(0, len(bits), 255):
        count += np.add.reduce(bits[at : at + 255], axis=0, dtype=np.uint8)
    return np.packbits(2 * count > len(h), bitorder="little").view("<u8")


def fingerprint(text: str | None, words: int = WORDS, wide: bool = False) -> list[int]:
    """The unsigned 64-bit fingerprint of a whole text and, if ``wide``, the three numbers of its print and its least values."""
    h = shingle_hashes(text, words)
    out = [int(x) for x in majority(h.reshape(-1, 1))]
    if wide:
        own = [longer(h, m) for m in PRINT_MIX]
        out += [int(x) for o in own for x in majority(o.reshape(-1, 1))] + least_values(own[0]).tolist()
    return out


def fingerprints(docs: DataFrame, words: int = WORDS, wide: bool = False) -> DataFrame:
    """doc_id, text_key (a hash of the text), fp (the fingerprint as a signed long) and, if ``wide``, the print for every row. Only the text goes to Python."""
    names = ["fp", *((*PRINT, *LEAST) if wide else ())]

    @F.pandas_udf(", ".join(f"{n} long" for n in names))
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            found = [fingerprint(t if isinstance(t, str) else None, words, wide) for t in texts]
            yield pd.DataFrame(np.array(found, dtype=np.uint64).reshape(-1, len(names)).view(np.int64), columns=names)

    scratch.small_batches(docs.sparkSession)
    text = F.col("text").cast("string")
    rows = scratch.dealt(docs.select("doc_id", "text")).select(F.col("doc_id").cast("long").alias("doc_id"), text_key(text).alias("text_key"), of(text).alias("_p"))
    return rows.select("doc_id", "text_key", *[F.col(f"_p.{n}").alias(n) for n in names])


def text_key(text: Column) -> Column:
    """What tells rows with one doc_id and different texts apart."""
    return F.xxhash64(text.cast("string"))


def _remainder(x: np.ndarray) -> np.ndarray:
    """x modulo the generator, for 23-bit words."""
    x = x.copy()
    for b in range(22, 10, -1):
        x ^= np.where(x >> b & 1, GENERATOR << (b - 11), 0)
    return x


def golay_errors() -> np.ndarray:
    """Syndrome -> error pattern of weight at most 3; each of the 2048 occurs once, as the code is perfect."""
    one = 1 << np.arange(23)
    i, j, k = np.triu_indices(23, 1), None, None
    two = one[i[0]] | one[i[1]]
    three = np.array([one[a] | one[b] | one[c] for a in range(23) for b in range(a) for c in range(b)])
    patterns = np.concatenate([[0], one, two, three])
    out = np.zeros(2048, dtype=np.int64)
    out[_remainder(patterns)] = patterns
    return out


_TABLES: dict[str, np.ndarray] = {}


def index_of(x: np.ndarray) -> np.ndarray:
    """The index (0 to 4095) of the codeword within 3 bits of each 23-bit word."""
    if not _TABLES:
        _TABLES["errors"] = golay_errors()
        _TABLES["syndrome"] = _remainder(np.arange(1 << 23)).astype(np.int16)
    return (x ^ _TABLES["errors"][_TABLES["syndrome"][x]]) >> 11


def near(x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, indices): for each word the different indices of itself and its one-bit changes."""
    flips = np.concatenate([[0], 1 << np.arange(width)])
    idx = np.sort(index_of(x[:, None] ^ flips[None, :]), axis=1)
    new = np.ones(idx.shape, bool)
    new[:, 1:] = idx[:, 1:] != idx[:, :-1]
    row, col = np.nonzero(new)
    return row, idx[row, col]


def keys(fp: np.ndarray, first: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row numbers, keys, whether the tolerant index is the segment's own) of fingerprints as first or second of a pair."""
    u = fp.view(np.uint64)
    seg = [(u >> np.uint64(s) & np.uint64((1 << w) - 1)).astype(np.int64) for s, w in zip(SHIFTS, WIDTHS, strict=True)]
    own = [index_of(s) for s in seg]
    around = [near(s, w) for s, w in zip(seg, WIDTHS, strict=True)]
    rows, out, exact = [], [], []
    for i in range(3):
        for j in range(3):
            if i != j:
                row, idx = around[j]
                rows.append(row)
                out.append(((3 * i + j) << 40) | seg[i][row] << 12 | idx)
                exact.append(idx == own[j][row])
            if i < j:
                row, idx = around[i if first else j]
                a, b = (idx, own[j][row]) if first else (own[i][row], idx)
                rows.append(row)
                out.append(((9 + 3 * i + j) << 40) | a << 12 | b)
                exact.append(np.ones(len(row), bool))
    return np.concatenate(rows), np.concatenate(out), np.concatenate(exact)


def _keyed(fps: DataFrame, first: bool) -> DataFrame:
    side = "l" if first else "r"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            row, key, exact = keys(batch.fp.to_numpy(np.int64), first)
            yield pd.DataFrame({"key": key, f"{side}_fp": batch.fp.to_numpy()[row], f"{side}_at": batch["at"].to_numpy()[row], f"{side}_own": exact})

    return fps.select("fp", "at").mapInPandas(run, f"key long, {side}_fp long, {side}_at long, {side}_own boolean")


def way(x: Column) -> Column:
    """Which key case finds a pair with these differing bits: the first that holds, as in ``keys``."""
    e = [F.bit_count(x.bitwiseAND(F.lit(((1 << w) - 1) << s).cast("long"))) for s, w in zip(SHIFTS[1:], WIDTHS[1:], strict=True)]
    top = F.bit_count(F.shiftrightunsigned(x, 42))
    e = [top, *e]
    out = F.lit(None).cast("int")
    for i, j in ((1, 2), (0, 2), (0, 1)):
        out = F.when((e[i] == 1) & (e[j] == 1), 9 + 3 * i + j).otherwise(out)
    for i, (j, k) in ((2, (0, 1)), (1, (0, 2)), (0, (1, 2))):
        out = F.when(e[i] == 0, F.when(e[j] <= 2, 3 * i + j).otherwise(3 * i + k)).otherwise(out)
    return out


def equal_tolerant(x: Column) -> Column:
    """Whether the tolerant segment of that case is equal too (then both sides share all its indices)."""
    e = [F.bit_count(F.shiftrightunsigned(x, 42)), *[F.bit_count(x.bitwiseAND(F.lit(((1 << w) - 1) << s).cast("long"))) for s, w in zip(SHIFTS[1:], WIDTHS[1:], strict=True)]]
    w = way(x)
    return F.when(w < 9, F.when(w % 3 == 0, e[0]).when(w % 3 == 1, e[1]).otherwise(e[2]) == 0).otherwise(F.lit(False))


def stars(fps: DataFrame) -> DataFrame:
    """Links (a, b) of each fingerprint to the smallest that agrees with it in two segments, where they are near."""
    masks = [-1 ^ (((1 << w) - 1) << s) for s, w in zip(SHIFTS, WIDTHS, strict=True)]
    masks = [m if m < 1 << 63 else m - (1 << 64) for m in (m & (1 << 64) - 1 for m in masks)]
    parts = [F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("bits")) for i, m in enumerate(masks)]
    rows = fps.select("fp", F.explode(F.array(*parts)).alias("p")).select("fp", "p.i", "p.bits")
    hub = rows.groupBy("i", "bits").agg(F.min("fp").alias("hub"), F.count("*").alias("n")).where("n > 1").drop("n")
    return rows.join(hub, ["i", "bits"]).where((F.col("fp") != F.col("hub")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("hub"))) <= DISTANCE)).select(
        F.col("hub").alias("a"), F.col("fp").alias("b")
    )


def near_pairs(at: DataFrame) -> DataFrame:
    """Links (a, b) of fingerprints at most ``DISTANCE`` apart that are at different places; ``at``: fp, at.

    A fingerprint has dozens of keys, which Spark's estimate of the keyed table's size does not tell: it is
    merged with the other, lest a table of many times ``autoBroadcastJoinThreshold`` goes through the driver.
    """
    x = F.col("l_fp").bitwiseXOR(F.col("r_fp"))
    left, right = _keyed(at, True), _keyed(at, False)
    return left.hint("merge").join(
        right,
        (left["key"] == right["key"]) & (F.col("l_fp") < F.col("r_fp")) & (F.bit_count(x) <= DISTANCE) & (F.col("l_at") != F.col("r_at"))
        & (F.shiftright(left["key"], 40) == way(x)) & (~equal_tolerant(x) | (F.col("l_own") & F.col("r_own"))),
    ).select(F.col("l_fp").alias("a"), F.col("r_fp").alias("b"))


def links(fps: DataFrame) -> DataFrame:
    """Links (a, b) that connect what fingerprints at most ``DISTANCE`` apart connect. ``fps``: fp long, distinct."""
    star = scratch.table(stars(fps), "stars")
    connected = components(star)
    at = scratch.table(
        fps.select("fp").join(connected.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("component", "fp").alias("at")), "keyed"
    )
    found = near_pairs(at)
    return scratch.table(found.unionByName(star), "near")


def _print_keys(rows: DataFrame, crowd: bool = False) -> DataFrame:
    """(key, node, at) of each print's keys, and the least values (crowd) that went into the key if asked; a node is a text, by its hash."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        flips = np.concatenate([[0], 1 << np.arange(23)])
        for batch in batches:
            w = [batch[n].to_numpy(np.int64).view(np.uint64) for n in PRINT]
            # eight segments: two whole ones of each number, the other two of what is left above them
            left = [x >> np.uint64(46) for x in w]
            whole = [x >> np.uint64(s) for x in w for s in (0, 23)] + [left[0] | (left[1] & np.uint64(31)) << np.uint64(18), left[2] | (left[1] >> np.uint64(5) & np.uint64(31)) << np.uint64(18)]
            node, at = batch.node.to_numpy(np.int64), batch["at"].to_numpy(np.int64)
            for name, x in zip(LEAST, whole, strict=True):
                idx = np.sort(index_of((x & np.uint64((1 << 23) - 1)).astype(np.int64)[:, None] ^ flips), axis=1)
                new = np.ones(idx.shape, bool)
                new[:, 1:] = idx[:, 1:] != idx[:, :-1]
                row, col = np.nonzero(new)
                least = batch[name].to_numpy(np.int64)[row]
                key = mixed(least.view(np.uint64), idx[row, col].astype(np.uint64))
                yield pd.DataFrame({"key": key.view(np.int64), "node": node[row], "at": at[row]} | ({"crowd": least} if crowd else {}))

    return rows.select("node", "at", *PRINT, *LEAST).mapInPandas(run, "key long, node long, at long" + (", crowd long" if crowd else ""))


def meeting(keyed: DataFrame) -> DataFrame:
    """(key, node, at) of the keys under which texts of several components meet."""
    several = keyed.groupBy("key").agg(F.min("at").alias("_low"), F.max("at").alias("_high")).where("_low != _high").select("key")
    return keyed.join(several, "key", "left_semi")


def _near(left: str, right: str) -> Column:
    """Whether two prints differ in at most ``APART`` bits."""
    apart = [F.bit_count(F.col(f"{left}.{n}").bitwiseXOR(F.col(f"{right}.{n}"))) for n in PRINT]
    return apart[0] + apart[1] + apart[2] <= APART


def _hubs(keyed: DataFrame) -> DataFrame:
    """(hub, node): each key's smallest node and its others of other components, where their prints are near."""
    hub = keyed.groupBy("key").agg(F.min(F.struct("node", "at", "print")).alias("h")).select("key", "h.node", "h.at", "h.print").alias("h")
    k = keyed.alias("k")
    return k.join(hub, (F.col("k.key") == F.col("h.key")) & (F.col("k.at") != F.col("h.at")) & _near("k.print", "h.print")).select(F.col("h.node").alias("hub"), F.col("k.node").alias("node"))


def to_one_hub(keyed: DataFrame) -> DataFrame:
    """Pairs (a, b): for each node the smallest of its keys' smallest nodes, so not more pairs than nodes."""
    return _hubs(keyed).groupBy("node").agg(F.min("hub").alias("a")).select("a", F.col("node").alias("b"))


def to_hubs(keyed: DataFrame) -> DataFrame:
    """Pairs (a, b) of each key's smallest node and its others of other components."""
    return _hubs(keyed).select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()


def among(keyed: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes of different components under one key whose prints are near."""
    l, r = keyed.alias("l"), keyed.alias("r")
    met = l.join(r, (F.col("l.key") == F.col("r.key")) & (F.col("l.node") < F.col("r.node")) & (F.col("l.at") != F.col("r.at")) & _near("l.print", "r.print"))
    return met.select(F.col("l.node").alias("a"), F.col("r.node").alias("b")).distinct()


def full_keys(keyed: DataFrame) -> DataFrame:
    """The keys of more than ``FEW`` texts."""
    return keyed.groupBy("key").agg(F.count("*").alias("_n")).where(F.col("_n") > FEW).select("key")


def crowds(keyed: DataFrame, prints: DataFrame) -> DataFrame:
    """(crowd, node): texts under full keys, by the least values of the key."""
    full = scratch.table(full_keys(keyed), "full")
    nodes = keyed.join(full, "key", "left_semi").select("node").distinct()
    again = _print_keys(prints.join(nodes, "node", "left_semi"), True)
    return again.hint("merge").join(full, "key", "left_semi").select("crowd", "node").distinct()


def differences(crowd: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """For each (crowd, node) what tells it from its crowd.

    own: (df, item) of its shingles that others of the crowd have; common: (df, item) of the shingles of over half of the
    crowd, with the number that lack them; x: see above; least, middle: the smallest x in the crowd and whose it is.
    """
    slack = (1 - similarity) / (1 + similarity)
    n = crowd.groupBy("crowd").agg(F.count("*").alias("n"))
    rows = scratch.table(crowd.join(n, "crowd").withColumn("row", F.xxhash64("crowd", "node")), "crowds")
    met = rows.join(sets, "node")
    items = met.select("row", "crowd", F.explode("set").alias("s")).select("row", F.xxhash64("crowd", "s").alias("item"))
    several = items.withColumn("df", F.count("*").over(Window.partitionBy("item")).cast("int")).where("df > 1")
    own = several.groupBy("row").agg(F.collect_list(F.struct("df", "item")).alias("own"))
    sized = met.select("row", "crowd", "node", "n", F.size("set").alias("size")).join(own, "row").withColumn("held", F.size(F.filter("own", lambda i: 2 * i["df"] > F.col("n"))))
    sized = scratch.table(sized.withColumn("y", (1 - slack) * F.col("size") - 2 * F.col("held")), "sized")
    most = sized.select("crowd", "n", F.explode("own").alias("i")).where("2 * i.df > n").groupBy("crowd", "i.item").agg(F.first(F.col("n") - F.col("i.df")).cast("int").alias("df"))
    common = most.groupBy("crowd").agg(F.collect_list(F.struct("df", "item")).alias("common"))
    middle = sized.groupBy("crowd").agg(F.min(F.struct("y", "node")).alias("p"))
    whole = scratch.table(middle.join(common, "crowd", "left").select("crowd", "p", F.coalesce("common", F.expr("cast(array() as array<struct<df: int, item: bigint>>)")).alias("common")), "middles")
    shared = F.size("common")
    return sized.join(whole, "crowd").select(
        "crowd", "node", "own", "common", "n", (F.col("y") + shared).alias("x"), (F.col("p.y") + shared).alias("least"), F.col("p.node").alias("middle")
    )


#: What x, a sum of fractions, may be off by.
ROUNDING = 1e-6


def to_middle(told: DataFrame) -> DataFrame:
    """Pairs (a, b) of each crowd's middle and the texts that are similar to it whatever their differences are."""
    return told.where((F.col("x") + F.col("least") <= ROUNDING) & (F.col("node") != F.col("middle"))).select(F.col("middle").alias("a"), F.col("node").alias("b"))


def rare_differences(rows: DataFrame) -> DataFrame:
    """(item, node, x, far, rest): a text's differences, of those that others have too, behind which it has as many as any pair of it needs.

    rest counts them, the item included; far texts are those that ``to_middle`` leaves.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            far = (batch.x + batch.least > ROUNDING).to_numpy()
            need = (batch.x + np.where(far, batch.least, -batch.least)).to_numpy() / 2 - ROUNDING
            items, rests = [], []
            for own_df, own_item, common_df, common_item, n, enough in zip(batch.own_df, batch.own_item, batch.common_df, batch.common_item, batch.n, need, strict=True):
                more, lacks = 2 * own_df <= n, ~np.isin(common_item, own_item)
                df, item = np.append(own_df[more], common_df[lacks]), np.append(own_item[more], common_item[lacks])
                order = np.lexsort((item, df))  # what is its own alone stands before them
                rest = len(order) - np.arange(len(order))
                held = (df[order] > 1) & (rest >= enough)
                items.append(item[order[held]])
                rests.append(rest[held])
            times = [len(i) for i in items]
            yield pd.DataFrame({"item": np.concatenate(items), "node": np.repeat(batch.node.to_numpy(), times), "x": np.repeat(batch.x.to_numpy(), times), "far": np.repeat(far, times), "rest": np.concatenate(rests)})

    flat = [F.col(f"{c}.{f}").alias(f"{c}_{f}") for c in ("own", "common") for f in ("df", "item")]
    return rows.select("node", "n", "x", "least", *flat).mapInPandas(run, "item long, node long, x double, far boolean, rest int")


def of_rare(rare: DataFrame, at: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components that share a difference behind which both have enough. ``at``: node, at."""
    placed = scratch.table(rare.join(at, "node"), "rare")
    l, r = placed.alias("l"), placed.alias("r")
    needed = (F.col("l.x") + F.col("r.x")) / 2 - ROUNDING
    met = l.join(r, (F.col("l.item") == F.col("r.item")) & (F.col("l.node") < F.col("r.node")) & (F.col("l.at") != F.col("r.at")) & (F.col("l.far") | F.col("r.far")) & (F.least("l.rest", "r.rest") >= needed))
    return met.select(F.col("l.node").alias("a"), F.col("r.node").alias("b")).distinct()


def shingle_sets(docs: DataFrame, asked: DataFrame, words: int) -> DataFrame:
    """(node, set): the hashes of all shingles of each text asked for, one word longer than those of fingerprints, each once."""

    @F.pandas_udf("array<long>")
    def shingles(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([np.unique(longer(shingle_hashes(t, words))).view(np.int64) for t in texts], dtype=object)

    asked = scratch.table(asked, "asked")
    few = F.broadcast(asked) if asked.count() <= BROADCAST_KEYS else asked
    thin = docs.select(text_key(F.col("text")).alias("node"), F.col("text").cast("string").alias("text")).join(few, "node")
    once = thin.groupBy("node").agg(F.first("text").alias("text"))
    return scratch.table(once.select("node", shingles(F.coalesce("text", F.lit(""))).alias("set")), "sets")


def confirmed(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets share this part."""
    side = lambda name: sets.select(F.col("node").alias(name), F.col("set").alias(f"_{name}"))
    shared = F.size(F.array_intersect("_a", "_b"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where("size(_a) > 0 and size(_b) > 0")
    return both.where(shared >= similarity * (F.size("_a") + F.size("_b") - shared)).select("a", "b")


def similar(docs: DataFrame, rows: DataFrame, at: DataFrame, words: int, similarity: float) -> DataFrame:
    """at, component: how components whose candidates have similar texts are joined. ``rows``: fingerprints with prints; ``at``: fp and the component it is in already."""
    prints = rows.select("fp", F.col("text_key").alias("node"), *PRINT, *LEAST).dropDuplicates(["node"]).join(at, "fp")
    met = meeting(scratch.table(_print_keys(prints), "keys"))
    keyed = scratch.table(met.join(prints.select("node", F.struct(*PRINT).alias("print")), "node"), "meeting")

    def joined(links: DataFrame, of: DataFrame) -> DataFrame:
        name = lambda n: of.select(F.col("node").alias(n), F.col("at").alias(f"_{n}"))
        return links.join(name("a"), "a").join(name("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))

    own = scratch.table(keyed.select("node", "at").distinct(), "own")
    found = scratch.table(own.select(F.col("at").alias("a"), F.col("at").alias("b")).limit(0), "similar")
    of = components(found)

    def now(df: DataFrame) -> DataFrame:
        return df.join(of.withColumnsRenamed({"node": "at", "component": "_of"}), "at", "left").withColumn("at", F.coalesce("_of", "at")).drop("_of")

    def settle(pairs: DataFrame, sets: DataFrame | None = None) -> None:
        nonlocal found, of
        asked = scratch.table(pairs, "pairs")
        if asked.limit(1).count():
            sets = shingle_sets(docs, asked.select(F.col("a").alias("node")).union(asked.select("b")).distinct(), words) if sets is None else sets
            found = scratch.table(joined(confirmed(asked, sets, similarity), own).unionByName(found), "similar")
            of = components(found)

    # the first links are stars, so that a crowd under a key is one component before its pairs are looked at
    for pairs in (to_one_hub, to_hubs):
        settle(pairs(keyed))
        keyed = scratch.table(meeting(now(keyed)), "meeting")
    crowd = scratch.table(crowds(keyed, prints), "crowd")
    few = among(keyed.join(full_keys(keyed), "key", "left_anti"))
    if not crowd.limit(1).count():
        settle(few)
        return of
    sets = shingle_sets(docs, crowd.select("node").distinct(), words)
    told = differences(crowd, sets, similarity)
    settle(few.unionByName(to_middle(told)).distinct())
    settle(of_rare(rare_differences(told), now(own)), sets)
    return of


def cluster(docs: DataFrame, words: int = WORDS, similarity: float | None = SIMILARITY) -> DataFrame:
    """doc_id, text_key, fp long and component_id (smallest doc_id reachable, itself included) for every row.

    Rows are linked by fingerprints at most ``DISTANCE`` apart, and by texts that share ``similarity``
    of their shingles of one word more, of which the keys of prints find nearly all; None: by fingerprints alone.
    """
    rows = scratch.table(fingerprints(docs, words, similarity is not None), "fingerprints")
    distinct = scratch.table(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "distinct")
    of = components(links(distinct)).withColumnRenamed("node", "fp")
    if similarity is not None:
        at = scratch.table(distinct.select("fp").join(of, "fp", "left").select("fp", F.coalesce("component", "fp").alias("at")), "at")
        wider = similar(docs, rows, at, words, similarity).withColumnsRenamed({"node": "at", "component": "_wider"})
        of = at.join(wider, "at", "left").join(of, "fp", "left").select("fp", F.coalesce("_wider", "component").alias("component")).where("component is not null")
    shared = distinct.join(of, "fp", "left").where("n > 1 or component is not null").select("fp", "least", F.coalesce("component", "fp").alias("_c"))
    named = shared.groupBy("_c").agg(F.min("least").alias("component_id"))
    by_fp = shared.join(named, "_c").select("fp", "component_id", F.lit(True).alias("_met"))
    # A fingerprint may be that of very many rows: its one row here is dealt over salts.
    left = rows.select("doc_id", "text_key", "fp").withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    right = by_fp.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.join(right, ["fp", "_salt"], "left").select(
        "doc_id", "text_key", "fp", F.when(F.col("_met"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    )


def drop(docs: DataFrame, words: int = WORDS, similarity: float | None = SIMILARITY) -> DataFrame:
    """``docs`` with the smallest doc_id of each group alone; a row whose doc_id repeats it stays with it."""
    keys = ["_id", "_text_key"]
    others = cluster(docs, words, similarity).where(~F.col("doc_id").eqNullSafe(F.col("component_id")))
    gone = scratch.table(others.select(F.struct("doc_id").alias("_id"), F.col("text_key").alias("_text_key")), "gone")
    keyed = docs.select(scratch.whole(docs), F.struct(F.col("doc_id").cast("long").alias("doc_id")).alias("_id"), text_key(F.col("text")).alias("_text_key"))
    return without(keyed, gone, keys).select("_doc.*")


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
