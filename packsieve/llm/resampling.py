"""Operator 11: importance resampling towards a target text, by exact selection of the k-th key.

Features of a text are its runs of one to three words, hashed to ``BUCKETS`` buckets by
CRC-32. All raw and all target texts give two arrays of bucket counts, and these an
array of gains; a document's weight is the sum of the gains of its features, and its
score adds a Gumbel number made from its doc_id, so that the highest scores are a
draw without replacement in proportion to the weights.

Hashing. A CRC of a concatenation follows from the CRCs of its parts: the first part's
is carried over as many zero bytes as the second has, a linear map of 32 bits that
four table lookups apply. So each different word of a batch is hashed once, and
numpy makes the runs of two and three words from that.

Selection. The key of a document is (score descending, doc_id ascending), 128 bits. Its
digits of 16 bits are taken from the top: Spark counts the rows below the prefix found
so far by their next digit (65,536 counts at most reach the driver, whatever the
table), and the digit that holds the k-th row extends the prefix, until it is told
from all others. Only rows up to that key are range-sorted and ranked.

The scored documents and the selected ones are written tables, so a lost executor costs
its tasks. Each text is read twice, since gains need the counts of all.

Edge cases: null or wordless texts have no feature, weight 0 and a score of their own;
a null doc_id counts as an empty string in the draw and comes last among ties; rows that
repeat a doc_id are documents of their own, and wholly equal rows get ranks next to each
other; an empty table gives no rows, an empty target or k = 0 no error (no target:
T = 0); extra columns are dropped, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packsieve.llm import scratch, tokens

BUCKETS, RUN, LEAST_WORDS, PERCENT, SEED = 10_000, 3, 20, 5, 42
DIGIT, SLICE_CHARS = 16, 2_000_000
#: Bytes of a word: digits, letters with A-Z lowered, all of non-ASCII characters; any other becomes a space.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_CARRY: dict[int, np.ndarray] = {}


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_BYTES).split()


def _apply(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The linear map of ``table`` (four bytes' images) on 32-bit numbers."""
    return table[0, x & 255] ^ table[1, x >> 8 & 255] ^ table[2, x >> 16 & 255] ^ table[3, x >> 24]


def _images(of_bit: np.ndarray) -> np.ndarray:
    """The images of all values of each of four bytes, from those of the 32 bits."""
    out = np.zeros((4, 256), dtype=np.uint32)
    for b in range(32):
        out[b // 8, np.arange(256) >> b % 8 & 1 == 1] ^= of_bit[b]
    return out


def carry(n: int) -> np.ndarray:
    """The map that takes a text's CRC to its share in the CRC of that text and ``n`` bytes more."""
    if n not in _CARRY:
        bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
        if n == 1:  # crc32(b, s) is affine in s; what s alone adds is the map over one byte
            _CARRY[n] = _images(np.array([zlib.crc32(b"\0", int(s)) ^ zlib.crc32(b"\0") for s in bits], dtype=np.uint32))
        else:
            _CARRY[n] = _images(_apply(carry(n - n // 2), _apply(carry(n // 2), bits)))
    return _CARRY[n]


def carried(crc: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Each CRC carried over so many bytes."""
    out = np.zeros(len(crc), dtype=np.uint32)
    order = np.argsort(sizes, kind="stable")
    cuts = np.flatnonzero(np.diff(sizes[order])) + 1
    for part in np.split(order, cuts):
        if len(part):
            out[part] = _apply(carry(int(sizes[part[0]])), crc[part])
    return out


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of each text, features of each text, buckets of all features in the order of texts)."""
    own = [words(t) for t in texts]
    n = np.array([len(w) for w in own], dtype=np.int64)
    coded = pa.array([w for ws in own for w in ws], pa.large_binary()).dictionary_encode()
    del own
    different, code = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
    size = np.array([len(w) + 1 for w in different], dtype=np.int64)
    first = np.array([zlib.crc32(w) for w in different], dtype=np.uint32)
    behind = np.array([zlib.crc32(b" " + w) for w in different], dtype=np.uint32)
    text = np.repeat(np.arange(len(texts)), n)
    place = np.arange(len(code)) - np.repeat(np.cumsum(n) - n, n)
    crc = first[code] if len(code) else np.zeros(0, np.uint32)
    owners, found = [text], [crc]
    for k in range(1, RUN):  # runs of k + 1 words from those of k: the last word is k further
        at = np.flatnonzero(place + k < n[text])
        last = code[at + k]
        longer = np.zeros(len(code), dtype=np.uint32)
        longer[at] = (carried(crc[at], size[last]) if len(at) else crc[:0]) ^ behind[last]
        crc = longer
        owners.append(text[at])
        found.append(crc[at])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return n, np.bincount(owner, minlength=len(texts)), (np.concatenate(found)[order] % BUCKETS).astype(np.int64)


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[str | None]]]:
    texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
    for a, b in tokens.slices([t or "" for t in texts], SLICE_CHARS):
        yield a, b, texts[a:b]


def bucket_counts(docs: DataFrame) -> DataFrame:
    """(bucket, n): how often features fall into each bucket, over all rows; a task sends ``BUCKETS`` numbers at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            for _, _, texts in _texts(batch):
                total += np.bincount(features(texts)[2], minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's smoothed shares in target and raw."""
    s, t = raw.astype(float), target.astype(float)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + len(s)) / ((s + 1) * (t.sum() + len(t))))).astype(np.int64)


def weighed(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight of every row."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            for a, b, texts in _texts(batch):
                n, k, buckets = features(texts)
                sums = np.concatenate([[0], np.cumsum(gain[buckets])])
                ends = np.cumsum(k)
                columns = [ids.slice(a, b - a), pa.array(n), pa.array(k.astype(np.int64)), pa.array(sums[ends] - sums[ends - k])]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """A Gumbel number in thousandths, from the id alone."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def digits(score: Column, doc_id: Column) -> list[Column]:
    """The key's digits from the top: unsigned order of these is (score descending, doc_id ascending, null last)."""
    sign = F.lit(-(1 << 63)).cast("long")
    halves = [F.bitwise_not(score).bitwiseXOR(sign), F.coalesce(doc_id, F.lit((1 << 63) - 1)).bitwiseXOR(sign)]
    return [F.shiftrightunsigned(x, s).bitwiseAND(F.lit((1 << DIGIT) - 1)).cast("int") for x in halves for s in range(64 - DIGIT, -1, -DIGIT)]


def kth(rows: DataFrame, k: int, n: int) -> list[int]:
    """The digits that the first ``k`` of ``n`` rows (score, doc_id) are told by: all of their keys begin at or below these, and no other's, ties of the whole key apart."""
    of = digits(F.col("score"), F.col("doc_id"))
    prefix: list[int] = []
    while len(prefix) < len(of) and k < n:
        here = rows.where(_at(of, prefix)) if prefix else rows
        counts = sorted((r[0], r[1]) for r in here.groupBy(of[len(prefix)].alias("digit")).count().collect())  # at most 2 ** DIGIT rows
        for digit, count in counts:
            if k <= count:
                prefix.append(digit)
                n = count  # rows that share the prefix; the first k of these are wanted
                break
            k -= count
    return prefix


def _at(of: list[Column], prefix: list[int]) -> Column:
    out = F.lit(True)
    for c, d in zip(of, prefix, strict=False):
        out = out & (c == d)
    return out


def _within(of: list[Column], prefix: list[int]) -> Column:
    """Whether a key's first digits are at most ``prefix``."""
    out = F.lit(True)
    for c, d in reversed(list(zip(of, prefix, strict=False))):
        out = (c < d) | (c == d) & out
    return out


def ranked(rows: DataFrame, k: int) -> DataFrame:
    """``rows`` with a rank by score descending, doc_id ascending; ranks above ``k`` are null. A row costs its range of the sort, never one task for all."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    sorted_ = scratch.table(rows.repartitionByRange(*order, F.col("n_features")).withColumn("_part", F.spark_partition_id()), "selected")
    counts = sorted((r[0], r[1]) for r in sorted_.groupBy("_part").count().collect())  # a number for each partition
    before, total = [], 0
    for part, count in counts:
        before.append((part, total))
        total += count
    offset = F.broadcast(rows.sparkSession.createDataFrame(before, "_part int, _before long"))
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(*order, "n_features")) + F.col("_before")
    return sorted_.join(offset, "_part").withColumn("rank", rank).withColumn("rank", F.when(F.col("rank") <= k, F.col("rank"))).drop("_part", "_before")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document: ``percent`` of those with enough words are drawn and ranked, the rest have no rank.

    ``docs``: doc_id, text; ``target``: text.
    """

    def array(df: DataFrame) -> np.ndarray:
        out = np.zeros(BUCKETS, dtype=np.int64)
        for r in bucket_counts(df).collect():  # at most BUCKETS rows
            out[r.bucket] = r.n
        return out

    score = F.col("weight") + gumbel(F.col("doc_id"), seed)
    scored = scratch.table(weighed(docs, gains(array(docs), array(target))).withColumn("score", score), "scored")
    enough = scored.where(F.col("n_words") >= least_words)
    n = enough.count()
    k = percent * n // 100
    out = ["doc_id", "n_features", "weight", "score"]
    none = F.lit(None).cast("long").alias("rank")
    if not k:
        return scored.select(*out, none)
    chosen = (F.col("n_words") >= least_words) & _within(digits(F.col("score"), F.col("doc_id")), kth(enough.select("score", "doc_id"), k, n))
    drawn = ranked(scored.where(chosen).select(*out), k)
    return scored.where(~chosen).select(*out, none).unionByName(drawn.select(*out, "rank"))
