"""Operator 1: packing token pieces into fixed windows by non-negative least squares.

Documents longer than the window are cut into full windows and a remainder. The
histogram of remainder lengths (at most ``window - 1`` counts, whatever the
corpus) goes to the driver. There the shallow combinations of lengths that fill
a window exactly are enumerated, ``min ||A x - h||, x >= 0`` gives how often each
is repeated, the repeats are rounded to what the histogram holds (down first, then
up by ones, so that the solution places 90 % of the remainders, or less where that makes fewer sequences), and what
is left is packed greedily on the histogram. The plan, a table with at most three
rows for each combination, is then dealt out in Spark: each remainder's rank
among those of its length says which sequence and place it takes; rows of the plan are
looked up by length and range of ranks, about two for each remainder. Its size depends
on the window and not on the corpus (about 210,000 rows, 13 MB, from some 2 million
remainders on); beyond ``PLAN_ROWS`` (far longer windows) it is joined and not broadcast.

Edge cases: a null text counts as empty; an empty text is the end id alone; a
null doc_id is a value like any other; repeated rows are packed each by itself;
an empty table gives no rows. Extra columns are dropped.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packsieve.llm import offsets, scratch, tokens

WINDOW, END_ID, VOCABULARY = 1024, 0, "byte_bpe_50k.json"
#: Shares of the remainders that whole repeats of the solution place, where they can; the greedy end needs some small ones, so the share that gives fewest sequences is taken.
SOLVED = (0.9, 0.8, 0.6, 0.4)
#: Rows of a plan (about 60 bytes each, told twice at most, once for each range of ranks) up to which it is broadcast; the default window's 88,000 combinations stay below.
PLAN_ROWS = 500_000
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, window: int = WINDOW, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """Tokenizes whole texts and cuts them at multiples of ``window``: a row per piece."""
    end = end_id.to_bytes(4, "little")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = tokens.encoder(tokens.vocabulary(vocabulary))
        for batch in batches:
            texts, doc_ids = [t if isinstance(t, str) else "" for t in batch.text], batch.doc_id.tolist()
            del batch
            for a, b in tokens.slices(texts):
                rows = []
                for doc_id, ids in zip(doc_ids[a:b], encoder.encode(texts[a:b]), strict=True):
                    ids += end
                    total = len(ids) // 4
                    for at in range(0, total, window):
                        part = ids[4 * at : 4 * (at + window)]
                        rows.append((None if doc_id is None else int(doc_id), at, len(part) // 4, zlib.crc32(part), total))
                out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
                yield out.astype({"doc_id": "Int64"})
        encoder.forget()

    # doc_id as Arrow sends it must stay exact next to nulls, hence text
    return docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(cut, PIECE)


def combinations(lengths: np.ndarray, window: int, depth: int = 3) -> np.ndarray:
    """All multisets of up to ``depth`` (1 to 3) of the lengths with sum ``window``; unused places hold 0."""
    there = np.zeros(window + 1, bool)
    there[lengths] = True
    found = [np.array([[window, 0, 0]])] if there[window] else []
    if depth >= 2:
        a = lengths[lengths * 2 <= window]
        a = a[there[window - a]]
        found.append(np.stack([window - a, a, 0 * a], axis=1))
    if depth >= 3:
        for a in lengths[lengths * 3 <= window]:
            b = lengths[(lengths >= a) & (lengths <= (window - a) // 2)]
            b = b[there[window - a - b]]
            found.append(np.stack([window - a - b, b, np.full_like(b, a)], axis=1))
    return np.concatenate(found) if found else np.zeros((0, 3), int)


def nnls(combos: np.ndarray, histogram: np.ndarray, steps: int = 400) -> np.ndarray:
    """Repeat counts x >= 0 with little ``||A x - h||``, by accelerated projected gradient.

    Column j of A counts the lengths in combination j, so A x is a weighted
    bincount and its transpose a gather; A itself is never built.
    """
    size = len(histogram)
    if not len(combos):
        return np.zeros(0)
    flat = combos.ravel()
    used = (combos > 0).astype(float)

    def forward(x: np.ndarray) -> np.ndarray:
        return np.bincount(flat, weights=(used * x[:, None]).ravel(), minlength=size)

    h = histogram.astype(float)
    v = np.random.default_rng(0).random(len(combos))
    for _ in range(30):  # the largest eigenvalue of A'A bounds the step
        v = (forward(v)[combos] * used).sum(axis=1)
        norm = np.linalg.norm(v)
        v /= norm
    step = 1 / (1.05 * norm)
    x = z = np.zeros(len(combos))
    t = 1.0
    for _ in range(steps):
        gradient = ((forward(z) - h)[combos] * used).sum(axis=1)
        new = np.maximum(z - step * gradient, 0)
        after = (1 + (1 + 4 * t * t) ** 0.5) / 2
        z = new + (t - 1) / after * (new - x)
        x, t = new, after
    return x


@dataclass(frozen=True)
class Pattern:
    """``repeats`` sequences, each of these lengths in this order."""

    lengths: tuple[int, ...]
    repeats: int


def plan(histogram: dict[int, int], window: int = WINDOW) -> list[Pattern]:
    """Patterns that use every length of the histogram exactly as often as it occurs."""
    left = np.zeros(window + 1, dtype=np.int64)
    for length, n in histogram.items():
        left[length] = n
    combos = combinations(np.flatnonzero(left), window)
    x = nnls(combos, left)
    plans = []
    for share in SOLVED:
        out = rounded(combos, x, left, share)
        plans.append(out + greedy(left - used(out, window), window))
    return min(plans, key=lambda p: sum(q.repeats for q in p))


def used(patterns: list[Pattern], window: int) -> np.ndarray:
    """How often the patterns use each length."""
    out = np.zeros(window + 1, dtype=np.int64)
    for p in patterns:
        for a in p.lengths:
            out[a] += p.repeats
    return out


def rounded(combos: np.ndarray, x: np.ndarray, h: np.ndarray, share: float) -> list[Pattern]:
    """Whole repeats of the combinations, near the solution ``x`` of the least squares and within the histogram ``h``.

    Counts are rounded down first. What that takes from their sum is handed out in ones, the largest
    remainders first, where the histogram still has the lengths, until ``share`` of it are placed.
    """
    left, repeats = h.tolist(), np.zeros(len(combos), dtype=np.int64)
    lists = combos.tolist()

    def take(j: int, n: int) -> None:
        lengths = [a for a in lists[j] if a]
        n = min([n, *(left[a] // lengths.count(a) for a in lengths)])
        for a in lengths:
            left[a] -= n
        repeats[j] += n

    floor = np.floor(x + 1e-9).astype(np.int64)
    for j in np.flatnonzero(floor).tolist():
        take(j, int(floor[j]))
    most = (1 - share) * int(h.sum())
    open_ = sum(left)
    for j in np.argsort(floor - x, kind="stable").tolist():
        if open_ <= most or x[j] <= floor[j]:
            break
        before = repeats[j]
        take(j, 1)
        open_ -= int(repeats[j] - before) * int((combos[j] > 0).sum())
    return [Pattern(tuple(a for a in lists[j] if a), int(repeats[j])) for j in np.flatnonzero(repeats).tolist()]


def greedy(left: np.ndarray, window: int) -> list[Pattern]:
    """Best-fit decreasing on a histogram: the longest left, then the longest that still fits, as often as it can."""
    left, out = left.copy(), []
    while left.any():
        room, lengths = window, []
        own = left.copy()
        while room:
            fits = np.flatnonzero(own[: room + 1])
            if not len(fits):
                break
            a = int(fits[-1])
            lengths.append(a)
            own[a] -= 1
            room -= a
        repeats = min(int(left[a]) // lengths.count(a) for a in lengths)
        for a in lengths:
            left[a] -= repeats
        out.append(Pattern(tuple(lengths), repeats))
    return out


def places(patterns: list[Pattern], first_sequence: int = 0) -> tuple[list[tuple], int]:
    """For each length, which ranks go where: (length, from_rank, to_rank, first sequence, offsets in it)."""
    rank: dict[int, int] = {}
    rows, sequence = [], first_sequence
    for p in patterns:
        at: dict[int, list[int]] = {}
        here = 0
        for a in p.lengths:
            at.setdefault(a, []).append(here)
            here += a
        for a, spots in at.items():
            first = rank.get(a, 0)
            rank[a] = first + p.repeats * len(spots)
            rows.append((a, first, rank[a], sequence, spots))
        sequence += p.repeats
    return rows, sequence


def widths(rows: list[tuple]) -> dict[int, int]:
    """For each length a range of ranks so wide that about one row of the plan begins in it."""
    n, top = Counter(r[0] for r in rows), {r[0]: r[2] for r in rows}
    return {a: -(-top[a] // k) for a, k in n.items()}


def pack(docs: DataFrame, window: int = WINDOW, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: ``PIECE`` and sequence_id, offset long.

    Sequences are numbered from 0 without gaps. The texts are tokenized once;
    what is shuffled and ranked are the pieces' numbers.
    """
    spark = docs.sparkSession
    cut = scratch.table(pieces(docs, window, vocabulary, end_id), "pieces")
    histogram = {r.length: r["count"] for r in cut.groupBy("length").count().collect()}  # at most `window` rows
    full = histogram.pop(window, 0)
    rows, _ = places([Pattern((window,), full)] * (full > 0) + plan(histogram, window))
    wide = F.broadcast(spark.createDataFrame(list(widths(rows).items()), "length long, _width long"))  # at most `window` rows
    where = spark.createDataFrame(rows, "length long, _from long, _to long, _first long, _spots array<int>").join(wide, "length")
    where = where.withColumn("_part", F.explode(F.sequence(F.expr("_from div _width"), F.expr("(_to - 1) div _width")))).drop("_width")
    ranked = offsets.with_offsets(
        cut, ["length"], ["doc_id", "start", "ids_crc32"], F.lit(1), offsets.bucket_count(sum(histogram.values()) + full), "_rank"
    )
    nth, each = F.col("_rank") - F.col("_from"), F.size("_spots")
    ranked = ranked.join(wide, "length").withColumn("_part", F.expr("_rank div _width"))
    placed = ranked.join(F.broadcast(where) if len(rows) <= PLAN_ROWS else where, ["length", "_part"]).where("_rank >= _from and _rank < _to")
    return placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("_first") + F.expr("(_rank - _from) div size(_spots)")).alias("sequence_id"),
        F.element_at("_spots", (nth % each + 1).cast("int")).cast("long").alias("offset"),
    )
