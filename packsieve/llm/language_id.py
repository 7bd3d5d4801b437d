"""Operator 5: language identification by cross-parsing.

A text is parsed against the labelled text of a language into the longest
phrases that occur there; the fewer phrases, normalised by its length and by
what a phrase costs (log2 of the labelled text's size), the nearer the language
(the cross-parsing estimate of relative entropy). A suffix automaton of the
labelled text accepts exactly its substrings, so following transitions until
one is missing yields each longest match.

The automata are fitted on a bounded sample: ``ROWS`` rows of each language
(those with the smallest hashes of their ids) and ``CHARS`` characters of each,
taken from a place that the hash picks. Languages are few; at most ``LANGUAGES``
are learned (the most frequent; more raise an error rather than being dropped).
The samples are sent to the executors as text and every Python worker builds
the automata once: all letters of the samples are told apart, with dense
transition tables for the ``DENSE`` most frequent and a sorted list of transitions
for the rarer ones. A letter that a language's sample lacks has no transition
there; it ends a phrase and costs as much more as naming a letter does (log2 of
their number), so a small sample doesn't win by what it does not know.

Prediction reads every character of every text. Texts are cut into blocks that
numpy steps through side by side, one character of all blocks and languages at
a time; a cut ends one phrase early, at the same places for every language.

Edge cases: null text, or text without a letter: ``und`` with score 0. Ties:
the smallest language name. No labelled rows: all ``und``. Extra columns are
not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packsieve.llm import scratch

ROWS, CHARS, LANGUAGES = 48, 800, 500
BLOCK, CHUNK = 512, 1_000_000
DENSE = 250
RESULT = "doc_id long, held_out boolean, lang_pred string, score double"
_MODELS: dict[int, Model] = {}


def fold(text: str) -> str:
    """Lower case, anything but letters as one space."""
    return "".join(c.lower()[0] if c.isalpha() else " " for c in text)


def transitions(text: np.ndarray) -> list[dict[int, int]]:
    """The suffix automaton of ``text`` (letter numbers): for each state, letter -> state."""
    last, link, length = 0, [-1], [0]
    step: list[dict[int, int]] = [{}]
    for c in text.tolist():
        new = len(link)
        link.append(0)
        length.append(length[last] + 1)
        step.append({})
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                clone = len(link)
                link.append(link[q])
                length.append(length[p] + 1)
                step.append(dict(step[q]))
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    return step


def split(step: list[dict[int, int]], letters: int) -> tuple[np.ndarray, np.ndarray]:
    """(state x letter -> state, or -1, of letters below ``letters``; rows of state, letter, state of the others)."""
    table = np.full((len(step), letters), -1, dtype=np.int32)
    rare: list[tuple[int, int, int]] = []
    for s, out in enumerate(step):
        for c, to in out.items():
            if c < letters:
                table[s, c] = to
            else:
                rare.append((s, c, to))
    return table, np.array(rare, dtype=np.int64).reshape(-1, 3)


def automaton(text: np.ndarray, letters: int) -> np.ndarray:
    """Transitions of the suffix automaton of ``text``, all of whose letters are below ``letters``: state x letter -> state, or -1."""
    return split(transitions(text), letters)[0]


class Model:
    """Labelled samples by language, as automata that share one alphabet."""

    def __init__(self, samples: dict[str, list[str]]):
        self.languages = sorted(samples)
        texts = {k: " ".join(" ".join(fold(t).split()) for t in samples[k]) + " " for k in self.languages}
        seen = np.frombuffer("".join(texts.values()).encode("utf-32-le"), dtype="<u4")
        chars, counts = np.unique(seen, return_counts=True)
        chars = chars[np.argsort(-counts, kind="stable")]
        # 0 is the space; 1 any letter that no sample holds, which no transition takes; 2.. the samples' letters, frequent ones first
        letter = [c for c in chars.tolist() if c != 32]
        number = {c: i + 2 for i, c in enumerate(letter)}
        self.literal = math.log2(max(2, len(letter)))
        self.letters = min(len(letter), DENSE) + 2
        self.of = np.zeros(0x110000, dtype=np.int32)
        for c in range(0x110000):
            x = chr(c)
            if x.isalpha():
                self.of[c] = number.get(ord(x.lower()[0]), 1)
        steps, rare, cost, base = [], [], [], 0
        for k in self.languages:
            own = self.of[np.frombuffer(texts[k].encode("utf-32-le"), dtype="<u4")]
            table, others = split(transitions(own), self.letters)
            rare.append(others + [base, 0, base])
            start = np.maximum(table[0], 0)
            # a missing transition starts the next phrase with this letter: told by the sign
            steps.append(np.where(table >= 0, table + base, -(start[None, :] + base) - 1).ravel())
            base += len(table)
            cost.append(math.log2(max(2, len(own))))
        roots = np.cumsum([0, *[len(s) // self.letters for s in steps]])[:-1]
        self.step = (np.concatenate(steps) if steps else np.zeros(0)).astype(np.int32)
        self.roots, self.cost = roots.astype(np.int32), np.array(cost)
        rows = np.concatenate(rare) if rare else np.zeros((0, 3), dtype=np.int64)
        key = rows[:, 0] << 21 | rows[:, 1]  # fewer letters than code points
        order = np.argsort(key, kind="stable")
        # a last key that no search is beyond
        self.rare, self.rare_to = np.append(key[order], np.iinfo(np.int64).max), np.append(rows[order, 2], 0).astype(np.int32)

    def lookup(self, state: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states of rare letters, and whether there is a transition."""
        key = state.astype(np.int64) << 21 | c
        at = np.searchsorted(self.rare, key)
        return self.rare_to[at], self.rare[at] == key

    def follow(self, state: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Next states by language and block; negative, as in ``step``, where a phrase ends."""
        far = np.flatnonzero(c >= self.letters)
        if not len(far):
            return self.step[state * self.letters + c]
        next_ = self.step[state * self.letters + np.minimum(c, self.letters - 1)]
        to, there = self.lookup(state[:, far], c[far])
        roots = np.broadcast_to(self.roots[:, None], to.shape)
        first, known = self.lookup(roots, c[far])
        next_[:, far] = np.where(there, to, -np.where(known, first, roots) - 1)
        return next_

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text: phrases and unknown letters by language, and letters and single spaces parsed."""
        size = np.array([len(t) for t in texts])
        all_chars = self.of[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")]
        owner = np.repeat(np.arange(len(texts)), size)
        first = np.ones(len(owner), bool)
        first[1:] = owner[1:] != owner[:-1]
        keep = all_chars > 0
        keep[1:] |= (all_chars[:-1] > 0) & ~first[1:]  # of other characters between letters, one space
        chars, owner = all_chars[keep], owner[keep]
        parsed = np.bincount(owner, minlength=len(texts))
        blocks = -(-parsed // BLOCK)
        of_block = np.repeat(np.arange(len(texts)), blocks)
        begin = np.concatenate([[0], np.cumsum(parsed)])[:-1]
        at = np.arange(len(of_block)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        start = begin[of_block] + at * BLOCK
        length = np.minimum(BLOCK, parsed[of_block] - at * BLOCK)
        order = np.argsort(-length, kind="stable")  # longer blocks first: those still running are a prefix
        of_block, start, length = of_block[order], start[order], length[order]
        state = np.repeat(self.roots[:, None], len(start), axis=1)
        count = np.ones((len(self.languages), len(start)), dtype=np.int32)
        unknown = np.zeros_like(count)
        running = np.searchsorted(-length, -np.arange(1, BLOCK + 1), side="right")
        for i in range(int(length.max()) if len(length) else 0):
            n = running[i]
            c = chars[start[:n] + i]
            next_ = self.follow(state[:, :n], c)
            miss = next_ < 0
            count[:, :n] += miss
            state[:, :n] = np.where(miss, -next_ - 1, next_)
            unknown[:, :n] += state[:, :n] == self.roots[:, None]  # no letter that is known leads to the root
        out, lost = np.zeros((2, len(texts), len(self.languages)))
        for j in range(len(self.languages)):
            out[:, j] = np.bincount(of_block, weights=count[j], minlength=len(texts))
            lost[:, j] = np.bincount(of_block, weights=unknown[j], minlength=len(texts))
        return out, lost, parsed

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        if not self.languages:
            return ["und"] * len(texts), [0.0] * len(texts)
        pred, score = [], []
        at = 0
        while at < len(texts):
            part, chars = [], 0
            while at < len(texts) and (not part or chars + len(texts[at] or "") <= CHUNK):
                part.append(texts[at] or "")
                chars += len(part[-1])
                at += 1
            n, lost, parsed = self.phrases(part)
            rate = (n * self.cost + lost * self.literal) / np.maximum(parsed, 1)[:, None]
            best = np.argmin(rate, axis=1)
            weight = 1 / np.maximum(rate, 1e-9)
            sure = weight.max(axis=1) / weight.sum(axis=1)
            pred += [self.languages[b] if p else "und" for b, p in zip(best, parsed, strict=True)]
            score += [float(s) if p else 0.0 for s, p in zip(sure, parsed, strict=True)]
        return pred, score


def sample(docs: DataFrame, held_out: F.Column, rows: int = ROWS, chars: int = CHARS) -> dict[str, list[str]]:
    """At most ``rows`` excerpts of ``chars`` characters for each language, from rows that are not held out."""
    labelled = docs.where(~held_out & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = labelled.groupBy("lang").count().limit(LANGUAGES + 1).collect()
    if len(counts) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages are labelled")
    if not counts:
        return {}
    # Rows with a hash below the language's threshold: some three times as many as are used, whatever the corpus.
    share = F.create_map(*[F.lit(x) for r in counts for x in (r.lang, min(1.0, 3.0 * rows / r["count"] + 30.0 / r["count"]))])
    h = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(5)), F.lit(1 << 40))
    spot = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(6)), F.greatest(F.lit(1), F.length("text") - chars)).cast("int") + 1
    picked = labelled.where(h < F.element_at(share, F.col("lang")) * float(1 << 40)).select("lang", h.alias("h"), F.substr("text", spot, F.lit(chars)).alias("t"))
    out: dict[str, list[tuple]] = {}
    for r in picked.collect():
        out.setdefault(r.lang, []).append((r.h, r.t))
    return {k: [t for _, t in sorted(v)[:rows]] for k, v in out.items()}


def held_out_fifth() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(0)) % 5 == 0


def told(samples: dict[str, list[str]]):
    """A column function: text -> (lang_pred, score). Only the text goes to Python and only the answer comes back."""
    key = hash(tuple((k, tuple(v)) for k, v in sorted(samples.items())))

    @F.pandas_udf("lang_pred string, score double")
    def tell(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        if key not in _MODELS:
            _MODELS.clear()
            _MODELS[key] = Model(samples)
        for texts in batches:
            pred, score = _MODELS[key].predict([t if isinstance(t, str) else None for t in texts])
            yield pd.DataFrame({"lang_pred": pred, "score": score})

    return tell


def predict(docs: DataFrame, samples: dict[str, list[str]]) -> DataFrame:
    """``docs`` with lang_pred and score of every row's whole text."""
    scratch.small_batches(docs.sparkSession)
    return docs.withColumn("_told", told(samples)(F.col("text").cast("string"))).select(*docs.columns, "_told.lang_pred", "_told.score")


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learns from the labelled rows that are not held out."""
    samples = sample(docs, held_out_fifth())
    ready = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out_fifth().alias("held_out"), "text")
    return predict(ready, samples).drop("text")


def keep(docs: DataFrame, minimum: float = 0.0) -> DataFrame:
    """``docs`` without the rows whose language can't be told (``und``, or a score below ``minimum``)."""
    scratch.small_batches(docs.sparkSession)
    marked = docs.select(scratch.whole(docs), told(sample(docs, held_out_fifth()))(F.col("text").cast("string")).alias("_told"))
    return marked.where((F.col("_told.lang_pred") != "und") & (F.col("_told.score") >= minimum)).select("_doc.*")
