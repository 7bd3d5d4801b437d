"""Operator 9: mixing sources to target weights in fixed-length blocks.

Each source's words, in a fixed pseudorandom order of its documents, form one
stream that is cut into blocks of ``BLOCK`` words, or of a ``PARTS``-th of the
source where that is less. A source's target, rounded to whole words, gives its
number of slots in the real words of its blocks: whole passes, then blocks until
the words left over are met, of which the last slot takes only what is missing.
So each source's taken words are its target. Output shards draw their source counts one after
another from a multinomial over what the sources have left, so that the draws
add up to the slots exactly. Shards have about ``SHARD_SLOTS`` slots, so their number
grows with the corpus: the driver draws for groups of shards, and Spark tasks draw
for the shards of a group in the same way, then deal ranges of at most ``RANGE`` slots. Slot n of a source takes the block at place
n modulo its number of blocks of a pseudorandom permutation, one permutation for
every pass, so no block is taken more often than a pass begins. Slots and blocks
meet in a join on (source, block).

Permutations are keyed Feistel networks on the block index with cycle walking:
an index is computed, not looked up, so no permutation is ever stored.

What the driver holds is one row per source (at most ``SOURCES``; more raise an
error) and the counts of at most ``GROUPS`` groups of shards, ``COUNTS`` numbers at most.

Edge cases: null or wordless text has size 0, is never taken and belongs to no
block; a null source is a source of its own, last in order; a source without
words has target 0; rows that repeat a doc_id are placed each by itself and
reported each by itself; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packsieve.llm import offsets, scratch

BLOCK, PARTS, SOURCES, SEED = 128, 16, 100_000, 17
#: Slots of an output shard; the driver draws for at most so many groups of shards and counts; slots of a range and of a task.
SHARD_SLOTS, GROUPS, COUNTS, RANGE, TASK_SLOTS = 1000, 1024, 1_000_000, 4096, 65536
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2.0
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[tuple[str | None, int]], weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> dict[str | None, float]:
    """Words wanted of each source: shares by weight, stopped at ``most`` times the size, the excess shared out again."""
    order = sorted((s for s in sizes if s[0] is not None), key=lambda s: s[0]) + [s for s in sizes if s[0] is None]
    weight = {name: weights[i % len(weights)] for i, (name, _) in enumerate(order)}
    limit = {name: most * n for name, n in order}
    out: dict[str | None, float] = {}
    open_, left = dict(weight), share * sum(n for _, n in order)
    while open_:
        unit = left / sum(open_.values())
        over = [name for name in open_ if open_[name] * unit > limit[name]]
        if not over:
            return out | {name: w * unit for name, w in open_.items()}
        for name in over:
            out[name] = limit[name]
            left -= limit[name]
            del open_[name]
    return out


def draw(slots: np.ndarray, parts: Sequence[int], seed: int | list[int] = SEED) -> Iterator[np.ndarray]:
    """For each part, multinomial counts by source; all add up to ``slots``, and a part's sum is its share by ``parts`` of all."""
    rng = np.random.default_rng(seed)
    left, open_ = slots.astype(np.int64).copy(), sum(parts)
    for part in parts:
        size = int(left.sum()) * part // open_
        open_ -= part
        take = np.zeros(len(slots), dtype=np.int64)
        while (short := size - int(take.sum())) > 0:
            rest = left - take
            take = np.minimum(left, take + rng.multinomial(short, rest / rest.sum()))
        left -= take
        yield take


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray, back: bool = False) -> np.ndarray:
    """A keyed permutation of range(size) at ``index``: four Feistel rounds, repeated until the value is in range; its inverse if ``back``."""
    bits = np.maximum(1, (np.ceil(np.log2(np.maximum(size, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << bits) - np.uint64(1)
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    key = key.astype(np.uint64)
    while len(todo):
        b, m, k = bits[todo], mask[todo], key[todo]
        left, right = out[todo] >> b, out[todo] & m
        if back:
            left, right = right, left
        for r in range(3, -1, -1) if back else range(4):
            x = (right + k + np.uint64(r)) * np.uint64(0x9E3779B97F4A7C15)
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((x ^ (x >> np.uint64(32))) & m)
        if back:
            left, right = right, left
        out[todo] = (left << b) | right
        todo = todo[out[todo] >= size[todo].astype(np.uint64)]
    return out.astype(np.int64)


def pass_key(source_no: int, turn: np.ndarray, seed: int) -> np.ndarray:
    return source_no * 1_000_003 + turn * 7919 + seed


def schedule(source_no: int, size: int, want: int, block: int, seed: int) -> tuple[int, int]:
    """(slots, words of the last one) that take ``want`` of a source's ``size`` words in blocks of ``block``, the last block maybe shorter."""
    if not size or not want:
        return 0, 0
    blocks, turn, rest = -(-size // block), want // size, want % size
    end = size - (blocks - 1) * block  # words of the stream's last block
    at = lambda n, t, back=False: int(permuted(np.array([n]), np.array([blocks]), pass_key(source_no, np.array([t]), seed), back)[0])
    if not rest:
        return turn * blocks, end if at(blocks - 1, turn - 1) == blocks - 1 else block
    place = at(blocks - 1, turn, True)
    words = lambda m: m * block - (block - end if place < m else 0)
    m = -(-rest // block)
    m += words(m) < rest
    return turn * blocks + m, rest - words(m - 1)


def numbered(docs: DataFrame, carry: bool = False) -> DataFrame:
    """row, doc_id, source, size, text_key (tells rows of one doc_id apart) and ``_doc`` with all columns if asked for, of every row; written once, so rows keep their numbers."""
    own = [F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("size"), F.xxhash64(F.col("text").cast("string")).alias("text_key")]
    return scratch.table(docs.select(*own, *([scratch.whole(docs)] if carry else [])), "sizes")


def placed(rows: DataFrame) -> DataFrame:
    """row, doc_id, source, size and start (words of its source before it) of every row of ``numbered``; texts are not moved."""
    thin = rows.select("row", "doc_id", "source", "size", "text_key")
    return scratch.table(offsets.with_offsets(thin, ["source"], ["doc_id", "size", "text_key"], F.col("size"), offsets.bucket_count(thin.count()), "start"), "placed")


def mix(rows: DataFrame, block: int = BLOCK, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(sources, pieces) of a mix of ``rows``, as ``placed`` makes them.

    sources: source, source_size, target. pieces: one row per piece of a row's
    words in a drawn block: shard, slot, source, block, pass, row, doc_id, at
    (first word in the document), words.
    """
    spark = rows.sparkSession
    sizes = [(r.source, r.size) for r in rows.groupBy("source").agg(F.sum("size").alias("size")).limit(SOURCES + 1).collect()]
    if len(sizes) > SOURCES:
        raise ValueError(f"more than {SOURCES} sources")
    want = targets(sizes)
    order = sorted(want, key=lambda s: (s is None, s or ""))
    of = dict(sizes)
    length = [max(1, min(block, of[s] // PARTS)) for s in order]
    ends = [schedule(k, of[s], min(round(want[s]), int(MOST * of[s])), length[k], seed) for k, s in enumerate(order)]
    slots = np.array([n for n, _ in ends], dtype=np.int64)
    shards = max(1, int(slots.sum()) // SHARD_SLOTS)
    groups = max(1, min(GROUPS, COUNTS // max(1, len(order)), shards))
    of_group = [shards // groups + (g < shards % groups) for g in range(groups)]
    plan, shard, first = [], 0, np.zeros(len(order), dtype=np.int64)
    for g, counts in enumerate(draw(slots, of_group, seed)):
        plan.append((g, shard, of_group[g], first.tolist(), counts.tolist()))
        shard, first = shard + of_group[g], first + counts

    def divide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for c in batch.itertuples():
                start = np.array(c.first, dtype=np.int64)
                for s, counts in enumerate(draw(np.array(c.counts, dtype=np.int64), [1] * c.shards, [seed, c.group])):
                    k = np.flatnonzero(counts)
                    yield pd.DataFrame({"shard": c.shard + s, "source_no": k, "n": counts[k], "first": start[k]})
                    start += counts

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for c in batch.itertuples():
                n = np.arange(c.first, c.first + c.n)
                turn = n // c.blocks
                at = permuted(n % c.blocks, np.full(len(n), c.blocks), pass_key(c.source_no, turn, seed))
                take = np.where(n == c.slots - 1, c.last, c.length)
                yield pd.DataFrame({"shard": c.shard, "slot": n, "source_no": c.source_no, "block": at, "pass": turn, "_take": take})

    names = spark.createDataFrame(
        [(k, s, of[s], float(want[s]), length[k]) for k, s in enumerate(order)], "source_no long, source string, source_size long, target double, _length long"
    )
    tasks = max(1, int(slots.sum()) // TASK_SLOTS)
    facts = F.broadcast(spark.createDataFrame([(k, -(-of[s] // length[k]), length[k], *ends[k]) for k, s in enumerate(order)], "source_no long, blocks long, length long, slots long, last long"))
    dealt = spark.createDataFrame(plan, "group long, shard long, shards long, first array<long>, counts array<long>").repartition(min(groups, tasks), "group")
    cells = dealt.mapInPandas(divide, "shard long, source_no long, n long, first long").withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(RANGE).cast("long"))))
    ranges = cells.select("shard", "source_no", F.least(F.lit(RANGE), F.col("n") - F.col("_from")).alias("n"), (F.col("first") + F.col("_from")).alias("first"))
    drawn = ranges.repartition(tasks, "shard", "source_no", "first").join(facts, "source_no").mapInPandas(deal, "shard long, slot long, source_no long, block long, pass long, _take long")
    named = rows.where("size > 0").join(F.broadcast(names.select("source_no", "_length", F.col("source").alias("_s"))), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    spans = named.withColumn("block", F.explode(F.sequence(F.expr("start div _length"), F.expr("(start + size - 1) div _length"))))
    begin = F.col("block") * F.col("_length")
    first = F.greatest(begin, F.col("start"))
    last = F.least(begin + F.col("_length"), F.col("start") + F.col("size"))
    spans = spans.select("source_no", "source", "block", "row", "doc_id", "size", (first - F.col("start")).alias("at"), (last - first).alias("words"), (first - begin).alias("_in_block"))
    pieces = drawn.join(spans, ["source_no", "block"]).withColumn("words", F.least("words", F.col("_take") - F.col("_in_block"))).where("words > 0")
    return names.drop("source_no", "_length"), pieces.drop("source_no", "_take", "_in_block")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken: for every row, the words that the mix takes of it."""
    rows = placed(numbered(docs))
    sources, pieces = mix(rows)
    taken = pieces.groupBy("row").agg(F.sum("words").alias("taken"))
    return (
        rows.join(taken, "row", "left")
        .join(F.broadcast(sources.withColumnRenamed("source", "_s")), F.col("source").eqNullSafe(F.col("_s")), "left")
        .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    )


def apply(docs: DataFrame) -> DataFrame:
    """The mix as documents: for each pass over a document, one row with the words taken, its other columns as they were.

    A row taken whole keeps its text as it is; of one taken in part, the words
    taken are joined by single spaces. ``n_chars``, where there, is counted anew.
    """
    rows = numbered(docs, carry=True)
    _, pieces = mix(placed(rows))
    # at most size / BLOCK + 2 pieces, or two for each block of a small source, of a row in a pass
    spots = pieces.groupBy("row", "pass").agg(F.array_sort(F.collect_list(F.struct("at", "words"))).alias("_spots"))
    text = F.col("_doc.text")
    word = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))
    part = F.array_join(F.flatten(F.transform("_spots", lambda p: F.slice("_words", (p["at"] + 1).cast("int"), p["words"].cast("int")))), " ")
    whole = F.aggregate("_spots", F.lit(0).cast("long"), lambda a, p: a + p["words"]) == F.col("size")
    out = rows.join(spots, "row").withColumn("_words", F.when(~whole, word)).withColumn("_text", F.when(whole, text).otherwise(part))
    new = {"text": F.col("_text"), "n_chars": F.length("_text")}
    return out.select(*[new.get(c, F.col(f"_doc.`{c}`")).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])
