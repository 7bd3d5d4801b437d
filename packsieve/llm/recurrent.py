"""Operator 13: log-likelihood of whole documents under a gated recurrent language model.

Counts. All training texts are counted by Spark, word by word; ``c``, ``N`` and ``V`` of the
base score come from there, and grow with the corpus. The most frequent words are told
apart by the model (``MODEL``), the others are one symbol to it; which of these it was,
the counts say, smoothed like the base. So the model gives every text a probability, with
words that it has never met too, and all of these sum to one.

Model. A gated recurrent unit reads word after word; a softmax over word classes and one
within the class of the word give the next; a tenth of a probability is the word's
share of the training texts. Classes are runs of words by frequency with
about the same sum of root frequencies. Before training the output biases alone are
set, to the frequencies, so the untrained model is the base at this vocabulary.

Training. Every training document is read once: in each of ``ROUNDS`` a further part of them (by a
hash) goes through tasks that start from the same weights, take windows of ``WINDOW`` words, propagate back inside the window and
carry the state over to the next (a text of over ``TRAIN_CUT`` words is several here). The tasks' weights are averaged by the words they have
seen, ``FAN`` at a time in Spark tasks; at most ``FAN`` sets of weights, whose size the
model fixes, reach the driver.

Scoring. Documents of a task run side by side in lanes, each from an empty state; the
state is carried across windows, so no text is cut and memory follows ``LANES`` and ``WINDOW``
alone. A worker knows the counts of the ``HELD`` most frequent words. Other words of a
document (none of these is frequent, whatever the table) are joined with the counts.

Edge cases: null and wordless texts are the end token alone; a null doc_id counts as an
empty string for the fold; rows that repeat a doc_id are scored each by itself; no
training rows: N = V = 0 and every word is unknown; an empty table gives no rows; extra columns
are dropped, whatever their names.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packsieve.llm import scratch

FOLDS, HELD_OUT = 5, 1
#: Words that the model tells apart, classes, size of the state; words whose counts each worker has.
MODEL, CLASSES, STATE, HELD = 2000, 32, 16, 50_000
#: Occurrences in training texts from which the model tells a word apart: rarer ones teach it where new words come.
SEEN = 3
#: Part of a symbol's probability that is its share of the training texts, so that few texts can't make the model too sure.
SMOOTH = 0.1
#: Training: rounds, one in so many training documents in all (1: every one), words of a window, words of a text read from one state, step, weight averages taken at a time.
ROUNDS, SHARE, WINDOW, TRAIN_CUT, RATE, FAN = 4, 1, 16, 512, 0.1, 8
#: Lanes of training: at least, and at most where that leaves so many steps.
LEAST_LANES, MOST_LANES, STEPS = 32, 512, 64
#: Scoring: lanes, and words scored at a time. Bytes of text split into words at a time.
LANES, GROUP_TOKENS, SLICE_BYTES = 1024, 4_000_000, 4_000_000


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts one behind the other, A-Z lowered, and where those of each text end."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat, offsets = split.values, split.offsets.to_numpy()
    held = pc.not_equal(flat, "")  # white space at an end leaves an empty word there
    return flat.filter(held), np.concatenate([[0], np.cumsum(held.to_numpy(zero_copy_only=False))])[offsets[1:]]


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of about ``SLICE_BYTES`` of text at a time."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + SLICE_BYTES, side="right")))
        yield batch.slice(at, to - at)
        at = to


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == HELD_OUT


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c, other): how often each word is in training texts and in the others; a null word counts the documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for other in (False, True):
                texts = batch.column("text").filter(pc.equal(batch.column("held_out"), other))
                found = pc.value_counts(words(texts)[0])
                word = pa.concat_arrays([found.field("values"), pa.nulls(1, pa.string())])
                n = pa.concat_arrays([found.field("counts"), pa.array([len(texts)], pa.int64())])
                zero = pa.array(np.zeros(len(n), dtype=np.int64))
                yield pa.RecordBatch.from_arrays([word, zero, n] if other else [word, n, zero], ["word", "c", "other"])

    parts = docs.select("held_out", "text").mapInArrow(count, "word string, c long, other long")
    return parts.groupBy("word").agg(F.sum("c").alias("c"), F.sum("other").alias("other"))


@dataclass
class Vocabulary:
    """What workers know of words: numbers of the frequent ones, their counts, their symbols in the model, and the sums of all counts."""

    words: pa.Array
    count: np.ndarray
    symbol: np.ndarray
    symbol_count: np.ndarray
    rare: int
    end: int
    classes: np.ndarray
    tokens: int
    types: int
    ends: int
    rare_tokens: int
    rare_types: int

    def log_base(self, count: np.ndarray | float) -> np.ndarray:
        return np.log10((count + 0.5) / (self.tokens + 0.5 * (self.types + 1)))

    def log_rare(self, count: np.ndarray | float) -> np.ndarray:
        """Which of the words that the model doesn't tell apart."""
        return np.log10((count + 0.5) / (self.rare_tokens + 0.5 * (self.rare_types + 1)))


def vocabulary(counts: DataFrame, model: int = MODEL, held: int = HELD, classes: int = CLASSES) -> Vocabulary:
    known = counts.where("word is not null")
    sums = known.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("v")).first()
    ends = (counts.where("word is null").agg(F.sum("c")).first()[0]) or 0
    top = known.orderBy(F.desc(F.col("c") + F.col("other")), "word").limit(held).select("word", "c").toArrow()
    c = top.column("c").to_numpy().astype(np.int64)
    order = np.lexsort((np.arange(len(c)), -c))
    own = [int(i) for i in order[:model] if c[i] >= SEEN]
    told = int(c[own].sum())
    # symbols by falling count, with those of rare words and of the end among them
    entries = [(int(c[i]), i) for i in own] + [(sums.n - told, -1), (ends, -2)]
    entries.sort(key=lambda e: (-e[0], e[1]))
    at = {i: s for s, (_, i) in enumerate(entries)}
    symbol = np.full(len(top) + 1, at[-1], dtype=np.int32)  # the last is that of words outside
    for i in own:
        symbol[i] = at[i]
    count = np.array([n for n, _ in entries], dtype=float)
    mass = np.cumsum(np.sqrt(count + 1))
    cut = np.searchsorted(mass, mass[-1] * np.arange(1, classes) / classes) + 1
    bounds = np.unique(np.concatenate([[0], cut[cut < len(entries)], [len(entries)]]))
    return Vocabulary(
        top.column("word").combine_chunks(), np.append(c, 0).astype(float), symbol, count, at[-1], at[-2], bounds,
        sums.n + ends, sums.v + (ends > 0), ends, sums.n - told, sums.v - len(own),
    )


Weights = dict[str, np.ndarray]


def fresh(v: Vocabulary, state: int = STATE) -> Weights:
    """Weights of a model that gives every symbol its frequency."""
    rng = np.random.default_rng(0)
    k, c = len(v.symbol_count), len(v.classes) - 1
    mass = np.add.reduceat(v.symbol_count + 1, v.classes[:-1])
    own = np.repeat(mass, np.diff(v.classes))
    w = {
        "x": rng.normal(0, 0.3, (k, 3 * state)), "u": rng.normal(0, 0.5 / math.sqrt(state), (state, 3 * state)),
        "cw": np.zeros((c, state)), "cb": np.log(mass / mass.sum()), "ow": np.zeros((k, state)), "ob": np.log((v.symbol_count + 1) / own),
    }
    w |= {f"{n}2": np.full_like(a, 0.01) for n, a in w.items()}  # sums of squared slopes, for the steps
    return {n: a.astype(np.float32) for n, a in w.items()}


def packed(w: Weights) -> bytes:
    return b"".join(w[n].tobytes() for n in sorted(w))


def unpacked(data: bytes, like: Weights) -> Weights:
    flat, at, out = np.frombuffer(data, np.float32), 0, {}
    for n in sorted(like):
        out[n] = flat[at : at + like[n].size].reshape(like[n].shape).copy()
        at += like[n].size
    return out


class Lanes:
    """Texts of symbols, each ended by ``end``, one behind the other in lanes of about the same length."""

    def __init__(self, texts: list[np.ndarray], lanes: int):
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        heap = [(0, lane) for lane in range(min(lanes, len(texts)))]
        own: list[list[int]] = [[] for _ in heap]
        for i in order:
            size, lane = heapq.heappop(heap)
            own[lane].append(i)
            heapq.heappush(heap, (size + len(texts[i]), lane))
        size = [sum(len(texts[i]) for i in ids) for ids in own]
        lanes_ = sorted(range(len(own)), key=lambda k: -size[k])
        #: Texts in the order in which they stand in ``flat``.
        self.order = [i for k in lanes_ for i in own[k]]
        self.flat = np.concatenate([texts[i] for i in self.order]) if texts else np.zeros(0, np.int32)
        self.size = np.array([size[k] for k in lanes_], dtype=np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.text_size = np.array([len(texts[i]) for i in self.order], dtype=np.int64)

    def active(self, t: int) -> int:
        """Lanes that have a symbol at step t."""
        return int(np.searchsorted(-self.size, -t, side="left"))


def _squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


#: Logits stay within this on either side, so that their powers can be summed as they are.
LIMIT = 40


def _powers(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """e to the logits, in place, and the sums of these."""
    np.clip(x, -LIMIT, LIMIT, out=x)
    np.exp(x, out=x)
    return x, x.sum(axis=1)


class Network:
    def __init__(self, w: Weights, classes: np.ndarray, end: int, shares: np.ndarray | None = None):
        """``shares``: of each symbol in training; with them, probabilities are mixed with these by ``SMOOTH``."""
        self.w, self.classes, self.end, self.shares = w, classes, end, shares
        self.state = w["u"].shape[0]
        self.class_of = np.repeat(np.arange(len(classes) - 1), np.diff(classes))

    def steps(self, lanes: Lanes, t0: int, h: np.ndarray, kept: list | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(states, places in ``flat``, last state) of a window from step t0 on. ``kept`` gets what the way back needs."""
        s, w = self.state, self.w
        states, places = [], []
        for t in range(t0, t0 + WINDOW):
            n = lanes.active(t)
            if not n:
                break
            at = lanes.start[:n] + t
            before = lanes.flat[at - 1] if t else np.full(n, self.end, dtype=np.int32)
            new = before == self.end  # a text begins: from an empty state
            h = np.where(new[:, None], np.float32(0), h[:n])
            x, g = w["x"][before], h @ w["u"]
            zr = _squash(x[:, : 2 * s] + g[:, : 2 * s])
            z, r = zr[:, :s], zr[:, s:]
            m = 2 * _squash(2 * (x[:, 2 * s :] + r * g[:, 2 * s :])) - 1
            if kept is not None:
                kept.append((before, new, h, z, r, m, g[:, 2 * s :]))
            h = m + z * (h - m)
            states.append(h)
            places.append(at)
        return np.concatenate(states), np.concatenate(places), h

    def within(self, targets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(first word, end, rows) of each class of several words that the targets are in."""
        c = self.class_of[targets]
        order = np.argsort(c, kind="stable")
        cuts = np.searchsorted(c[order], np.arange(len(self.classes)))
        for k in range(len(self.classes) - 1):
            a, b = int(self.classes[k]), int(self.classes[k + 1])
            if b - a > 1 and cuts[k] < cuts[k + 1]:
                yield a, b, order[cuts[k] : cuts[k + 1]]

    def log_probabilities(self, lanes: Lanes) -> np.ndarray:
        """The natural logarithm of every symbol's probability, in the order of ``flat``."""
        w, out = self.w, np.zeros(len(lanes.flat))
        h = np.zeros((len(lanes.size), self.state), np.float32)
        with np.errstate(over="ignore"):
            for t in range(0, int(lanes.size[0]) if len(lanes.size) else 0, WINDOW):
                states, places, h = self.steps(lanes, t, h, None)
                target = lanes.flat[places]
                e, total = _powers(states @ w["cw"].T + w["cb"])
                share = e[np.arange(len(e)), self.class_of[target]] / total
                for a, b, rows in self.within(target):
                    e, total = _powers(states[rows] @ w["ow"][a:b].T + w["ob"][a:b])
                    share[rows] *= e[np.arange(len(e)), target[rows] - a] / total
                out[places] = np.log(share.astype(float) if self.shares is None else (1 - SMOOTH) * share + SMOOTH * self.shares[target])
        return out

    def learn(self, lanes: Lanes, rate: float = RATE) -> None:
        """One pass of truncated backpropagation, a step after each window."""
        h = np.zeros((len(lanes.size), self.state), np.float32)
        with np.errstate(over="ignore"):
            for t in range(0, int(lanes.size[0]) if len(lanes.size) else 0, WINDOW):
                kept: list = []
                states, places, h = self.steps(lanes, t, h, kept)
                for name, at, slope in self.slopes(states, lanes.flat[places], kept):
                    self.step(name, at, slope / len(kept[0][0]), rate)

    def step(self, name: str, at: slice | np.ndarray, slope: np.ndarray, rate: float) -> None:
        slope = np.clip(slope, -1, 1)
        squares = self.w[f"{name}2"][at] + slope * slope
        self.w[f"{name}2"][at] = squares
        self.w[name][at] -= rate * slope / np.sqrt(squares)

    def slopes(self, states: np.ndarray, target: np.ndarray, kept: list) -> list[tuple[str, slice | np.ndarray, np.ndarray]]:
        """(weights, their rows, slope of the sum of negative log probabilities) of a window."""
        w, s, out = self.w, self.state, []
        every = slice(None)
        d, total = _powers(states @ w["cw"].T + w["cb"])
        d /= total[:, None]
        d[np.arange(len(d)), self.class_of[target]] -= 1
        back = d @ w["cw"]
        out += [("cw", every, d.T @ states), ("cb", every, d.sum(axis=0))]
        for a, b, rows in self.within(target):
            d, total = _powers(states[rows] @ w["ow"][a:b].T + w["ob"][a:b])
            d /= total[:, None]
            d[np.arange(len(d)), target[rows] - a] -= 1
            back[rows] += d @ w["ow"][a:b]
            out += [("ow", slice(a, b), d.T @ states[rows]), ("ob", slice(a, b), d.sum(axis=0))]
        du, dx, carried = np.zeros_like(w["u"]), [], np.zeros((0, s), np.float32)
        stop = len(states)
        for before, new, h, z, r, m, gm in reversed(kept):
            dh = back[stop - len(before) : stop].copy()
            stop -= len(before)
            dh[: len(carried)] += carried
            dm = dh * (1 - z) * (1 - m * m)
            dz, dr = dh * (h - m) * z * (1 - z), dm * gm * r * (1 - r)
            dg = np.concatenate([dz, dr, dm * r], axis=1)
            du += h.T @ dg
            dx.append(np.concatenate([dz, dr, dm], axis=1))
            carried = np.where(new[:, None], np.float32(0), dh * z + dg @ w["u"].T)
        symbols = np.concatenate([k[0] for k in reversed(kept)])
        order = np.argsort(symbols, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], np.diff(symbols[order]) != 0]))
        out += [("u", every, du), ("x", symbols[order][first], np.add.reduceat(np.concatenate(dx)[order], first))]
        return out


def _symbols(batch: pa.RecordBatch, v: Vocabulary) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(words of all texts, where those of each end, their numbers, and the symbols with an end behind each text)."""
    flat, ends = words(batch.column("text"))
    number = pc.fill_null(pc.index_in(flat, v.words), len(v.words)).to_numpy().astype(np.int64)
    symbols = np.full(len(number) + len(ends), v.end, dtype=np.int32)
    symbols[np.arange(len(number)) + np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))] = v.symbol[number]
    return flat, ends, number, symbols


def _pieces(batches: Iterator[pa.RecordBatch], v: Vocabulary) -> Iterator[list[np.ndarray]]:
    """Symbols of about ``GROUP_TOKENS`` words at a time, in texts of ``TRAIN_CUT`` words at most, so that lanes are of one length."""
    out, size = [], 0
    for batch in batches:
        for part in _slices(batch):
            _, ends, _, symbols = _symbols(part, v)
            for text in np.split(symbols, (ends + np.arange(1, len(ends) + 1))[:-1]):
                out += np.split(text, range(TRAIN_CUT, len(text), TRAIN_CUT))
                size += len(text)
            if size >= GROUP_TOKENS:
                yield out
                out, size = [], 0
    if out:
        yield out


def _facts(batch: pa.RecordBatch, v: Vocabulary) -> tuple[dict[str, pa.Array], list[np.ndarray]]:
    """What workers know of each document, with the words outside of their list, and its symbols."""
    flat, ends, number, symbols = _symbols(batch, v)
    n = np.diff(ends, prepend=0)
    text = np.repeat(np.arange(len(n)), n)
    inside = number < len(v.words)
    c, rare = v.count[number], inside & (v.symbol[number] == v.rare)
    each = lambda held, x: np.bincount(text[held], weights=x[held], minlength=len(n))
    # the other words: counted by text
    coded = flat.filter(pa.array(~inside)).dictionary_encode()
    key, times = np.unique(text[~inside] * max(1, len(coded.dictionary)) + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
    of, code = np.divmod(key, max(1, len(coded.dictionary)))
    offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(n)))]), pa.int32())
    columns = {
        "doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "n_tokens": pa.array(n + 1),
        "n_known": pa.array(each(inside, (c > 0).astype(float)).astype(np.int64) + (v.ends > 0)), "base": pa.array(each(inside, v.log_base(c)) + v.log_base(v.ends)),
        "score": pa.array(each(rare, v.log_rare(c))), "words": pa.ListArray.from_arrays(offsets, coded.dictionary.take(pa.array(code))), "times": pa.ListArray.from_arrays(offsets, pa.array(times, pa.int64())),
    }
    return columns, np.split(symbols, (ends + np.arange(1, len(ends) + 1))[:-1])


def turn(rounds: int = ROUNDS, share: int = SHARE) -> Column:
    """The round in which a training document is read; from ``rounds`` on: in none, which a share of 1 leaves out."""
    return F.pmod(F.xxhash64("doc_id", "text"), F.lit(rounds * share))


def train_lanes(words: int) -> int:
    """Texts read side by side: many are cheaper, but a step is made for all of them at once."""
    return min(MOST_LANES, max(LEAST_LANES, words // (WINDOW * STEPS)))


def trained(docs: DataFrame, v: Vocabulary, rounds: int = ROUNDS, share: int = SHARE, state: int = STATE, rate: float = RATE) -> Weights:
    """The weights after all rounds; ``docs`` as from ``_texts``."""
    spark = docs.sparkSession
    sent, like = spark.sparkContext.broadcast(v), fresh(v, state)
    part = turn(rounds, share)
    weights = like
    for k in range(rounds):
        start = spark.sparkContext.broadcast(packed(weights))

        def learn(batches: Iterator[pa.RecordBatch], start=start) -> Iterator[pa.RecordBatch]:
            v = sent.value
            seen, net = 0, Network(unpacked(start.value, fresh(v, state)), v.classes, v.end)
            for texts in _pieces(batches, v):
                size = sum(map(len, texts))
                net.learn(Lanes(texts, train_lanes(size)), rate)
                seen += size
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([seen]), pa.array([packed(net.w)])], ["seen", "weights"])

        now = docs.where(~F.col("held_out") & (part == k))
        weights = averaged(scratch.table(now.mapInArrow(learn, "seen long, weights binary").withColumn("task", F.spark_partition_id()), "weights"), weights)
        start.unpersist()
    return weights


def averaged(rows: DataFrame, before: Weights) -> Weights:
    """The average of weights (seen, weights, task), by what each has seen; none: ``before``."""

    def mean(parts: list[tuple[int, bytes]]) -> tuple[int, bytes]:
        seen = sum(n for n, _ in parts)
        total = sum(n / seen * np.frombuffer(x, np.float32).astype(float) for n, x in parts)
        return seen, total.astype(np.float32).tobytes()

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(n, x) for b in batches for n, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
        if parts:
            seen, data = mean(parts)
            yield pa.RecordBatch.from_arrays([pa.array([seen]), pa.array([data])], ["seen", "weights"])

    while (n := rows.count()) > FAN:
        fewer = rows.repartition(-(-n // FAN), (F.col("task") / FAN).cast("int")).sortWithinPartitions("task").select("seen", "weights")
        rows = scratch.table(fewer.mapInArrow(reduced, "seen long, weights binary").withColumn("task", F.spark_partition_id()), "weights")
    parts = [(r.seen, bytes(r.weights)) for r in rows.orderBy("task").collect()]  # at most FAN
    return unpacked(mean(parts)[1], before) if parts else before


def scored(docs: DataFrame, v: Vocabulary, weights: Weights) -> DataFrame:
    """row, doc_id, held_out, n_tokens, and of what workers know n_known, base, score; with the other words of each document."""
    spark = docs.sparkSession
    sent, held = spark.sparkContext.broadcast(v), spark.sparkContext.broadcast(packed(weights))
    state = weights["u"].shape[0]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        v = sent.value
        net = Network(unpacked(held.value, fresh(v, state)), v.classes, v.end, (v.symbol_count + 1) / (v.symbol_count + 1).sum())
        row = TaskContext.get().partitionId() << 33
        waiting: list[dict[str, pa.Array]] = []
        texts: list[np.ndarray] = []

        def done() -> Iterator[pa.RecordBatch]:
            """The scores of what is waiting; its documents run side by side."""
            nonlocal row
            lanes = Lanes(texts, LANES)
            sums = np.concatenate([[0], np.cumsum(net.log_probabilities(lanes))])
            stop, own, at = np.cumsum(lanes.text_size), np.zeros(len(texts)), 0
            own[lanes.order] = (sums[stop] - sums[stop - lanes.text_size]) / math.log(10)
            for facts in waiting:
                n = len(facts["doc_id"])
                facts["score"] = pa.array(facts["score"].to_numpy() + own[at : at + n])
                yield pa.RecordBatch.from_pydict({"row": pa.array(np.arange(row, row + n)), **facts})
                row, at = row + n, at + n
            waiting.clear()
            texts.clear()

        size = 0
        for batch in batches:
            for part in _slices(batch):
                facts, own = _facts(part, v)
                waiting.append(facts)
                texts += own
                size += sum(map(len, own))
                if size >= GROUP_TOKENS:
                    yield from done()
                    size = 0
        if texts:
            yield from done()

    schema = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, words array<string>, times array<long>"
    return docs.mapInArrow(score, schema)


def score(docs: DataFrame, rounds: int = ROUNDS, share: int = SHARE, model: int = MODEL, held: int = HELD, state: int = STATE, rate: float = RATE) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row (doc_id, text)."""
    texts = _texts(docs)
    counts = scratch.table(word_counts(texts), "counts")
    v = vocabulary(counts, model, held)
    weights = trained(texts, v, rounds, share, state, rate)
    told = scratch.table(scored(texts, v, weights), "scored")
    # the other words, none of them among the most frequent ones, so that no key is hot
    others = told.where("size(words) > 0").select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row", F.col("w.words").alias("word"), F.col("w.times").alias("n"))
    c, n = F.coalesce("c", F.lit(0)), F.col("n")
    met = others.join(counts.where("word is not null").select("word", "c"), "word", "left")
    share_of = lambda total: n * F.log10((c + 0.5) / F.lit(float(total)))
    sums = met.groupBy("row").agg(
        F.sum(F.when(c > 0, n).otherwise(0)).alias("_known"),
        F.sum(share_of(v.tokens + 0.5 * (v.types + 1))).alias("_base"),
        F.sum(share_of(v.rare_tokens + 0.5 * (v.rare_types + 1))).alias("_score"),
    )
    plus = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    return told.drop("words", "times").join(sums, "row", "left").select(
        "doc_id", "held_out", "n_tokens", plus("n_known", "_known").alias("n_known"), F.lit(v.tokens).cast("long").alias("train_tokens"),
        plus("base", "_base").alias("base_score"), plus("score", "_score").alias("score"),
    )
