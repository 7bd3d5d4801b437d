"""Importance resampling against a plain counter, with odd rows, ties and repeats."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from packsieve.llm import resampling
from tests.llm.test_operators import SCHEMA, documents

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_features(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return len(w), Counter(zlib.crc32(" ".join(w[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(w) - k + 1))


def plain(rows, target, percent=5, least=20):
    """(doc_id, n_features, weight, score, rank) of (doc_id, text) rows."""
    own, t = [plain_features(x) for _, x in rows], Counter()
    for x in target:
        t.update(plain_features(x)[1])
    s = sum((c for _, c in own), Counter())
    total, wanted = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (total + 10000) / ((s[b] + 1) * (wanted + 10000)))) for b in s}
    out = []
    for (doc_id, _), (n, c) in zip(rows, own, strict=True):
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] * k for b, k in c.items())
        out.append([doc_id, sum(c.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    enough = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for rank, r in enumerate(enough[: percent * len(enough) // 100], 1):
        r[4] = rank
    return Counter(tuple(r[:5]) for r in out)


def test_draw_is_that_of_a_plain_count(spark):
    docs = documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    benchmark = ["the an the an er", None, "", "Tier 3 über", rows[20][1]]
    target = spark.createDataFrame([(i, t, i) for i, t in enumerate(benchmark)], "item_id long, text string, weight int")
    for percent in (5, 50, 100):
        got = Counter(tuple(r) for r in resampling.resample(docs, target, percent).collect())
        assert got == plain(rows, benchmark, percent)
    none = spark.createDataFrame([], SCHEMA)
    assert resampling.resample(none, target).count() == 0
    assert Counter(tuple(r) for r in resampling.resample(docs, target.limit(0)).collect()) == plain(rows, [])


def test_kth_key_among_ties_and_repeated_rows(spark):
    """Scores and ids that differ in any digit, many ties, and the same row many times."""
    rows = spark.range(3000).selectExpr(
        "cast(case when id % 3 = 0 then 7 when id % 3 = 1 then -id * 1000000007 else id * 70000 end as long) score", "cast(case when id % 30 = 0 then null when id % 6 = 0 then 5 else id * 65537 - 9000000 end as long) doc_id", "1L n_features"
    ).cache()
    order = sorted(((r.score, r.doc_id) for r in rows.collect()), key=lambda r: (-r[0], r[1] is None, r[1] or 0))
    of = resampling.digits(F.col("score"), F.col("doc_id"))
    for k in (1, 999, 1000, 1001, 1500, 1800, 1950, 2000, 2999, 3000):
        prefix = resampling.kth(rows, k, 3000)
        chosen = rows.where(resampling._within(of, prefix))
        ties = sum(r == order[k - 1] for r in order)
        assert k <= chosen.count() < k + ties
        got = {r["rank"]: (r.score, r.doc_id) for r in resampling.ranked(chosen, k).collect() if r["rank"]}
        assert got == {i + 1: order[i] for i in range(k)}


def test_hashes_of_runs_are_those_of_whole_runs():
    texts = ["a", "", None, "Ab c9 c9-ab über " * 3, "w" * 5000 + " x " + "y" * 70_000, "one two"]
    n, k, buckets = resampling.features(texts)
    at = 0
    for text, words, features in zip(texts, n, k, strict=True):
        want = plain_features(text)
        assert (words, Counter(buckets[at : at + features].tolist())) == (want[0], want[1])
        at += features
    assert at == len(buckets)
    assert resampling.carried(np.array([1, 2], np.uint32), np.array([3, 3])).tolist() == [zlib.crc32(b"\0\0\0", c) ^ zlib.crc32(b"\0\0\0") for c in (1, 2)]
