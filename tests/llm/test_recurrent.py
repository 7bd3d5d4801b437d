"""The recurrent model: counts against a plain counter, a plain reader of one word at a time, slopes by differences, held-out gain."""

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from packsieve.llm import recurrent
from tests.llm.test_operators import SCHEMA, documents

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_words(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def is_out(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 == 1


def plain_base(rows):
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score) of (doc_id, text) rows; None is the end."""
    texts = [(i, is_out(i), [*plain_words(t), None]) for i, t in rows]
    c = Counter(w for _, out, ws in texts if not out for w in ws)
    n, v = sum(c.values()), len(c)
    return [(i, out, len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)) for i, out, ws in texts]


NAMES = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]


@pytest.mark.parametrize("held", [200_000, 40, 0])
def test_counts_and_base_are_those_of_a_plain_count(spark, monkeypatch, held):
    monkeypatch.setattr(recurrent, "SLICE_BYTES", 5000)
    monkeypatch.setattr(recurrent, "TRAIN_CUT", 50)
    monkeypatch.setattr(recurrent, "GROUP_TOKENS", 3000)
    docs = documents(spark)
    got = recurrent.score(docs, share=2, model=30, held=held, state=4)
    assert got.columns == NAMES
    key = lambda r: (str(r[0]), *map(str, r[1:5]), round(r[5], 6))
    rows = sorted(got.collect(), key=key)
    want = sorted(plain_base([(r.doc_id, r.text) for r in docs.collect()]), key=key)
    assert [tuple(r[:5]) for r in rows] == [w[:5] for w in want]
    assert all(math.isclose(r.base_score, w[5], rel_tol=1e-9) for r, w in zip(rows, want, strict=True))
    assert all(math.isfinite(r.score) and r.score < 0 for r in rows)


def test_no_rows_and_no_training_rows(spark):
    assert recurrent.score(spark.createDataFrame([], SCHEMA)).count() == 0
    ids = [i for i in range(40) if is_out(i)]
    rows = recurrent.score(spark.createDataFrame([(i, "some words") for i in ids], "doc_id long, text string")).collect()
    assert [(r.held_out, r.n_known, r.train_tokens, r.base_score) for r in rows] == [(True, 0, 0, 0.0)] * len(ids)


def model(rng, size=50, state=4, classes=5):
    count = np.sort(rng.integers(1, 100, size))[::-1].astype(float)
    bounds = np.array([0, 1, 5, 17, 30, size])[: classes + 1]
    v = recurrent.Vocabulary(pa.array([], pa.string()), np.zeros(1), np.zeros(1, np.int32), count, 3, 7, bounds, 0, 0, 0, 0, 0)
    w = recurrent.fresh(v, state)
    for n in w:
        if not n.endswith("2"):
            w[n] += rng.normal(0, 0.3, w[n].shape).astype(np.float32)
    return v, w


def plain_log(w, v, text):
    """Reads one symbol after the other; every symbol's probability, and whether they sum to one."""
    sig = lambda x: 1 / (1 + np.exp(-x))
    w = {n: a.astype(float) for n, a in w.items()}
    s, h, before, out = w["u"].shape[0], np.zeros(w["u"].shape[0]), v.end, []
    for target in text:
        x, g = w["x"][before], h @ w["u"]
        z, r = sig(x[:s] + g[:s]), sig(x[s : 2 * s] + g[s : 2 * s])
        m = np.tanh(x[2 * s :] + r * g[2 * s :])
        h = m + z * (h - m)
        c = np.exp(w["cw"] @ h + w["cb"])
        p = np.concatenate([c[k] / c.sum() * (e := np.exp(w["ow"][a:b] @ h + w["ob"][a:b])) / e.sum() for k, (a, b) in enumerate(zip(v.classes[:-1], v.classes[1:], strict=True))])
        assert abs(p.sum() - 1) < 1e-9
        out.append(math.log(p[target]))
        before = target
    return out


def test_lanes_and_windows_give_what_reading_one_text_gives():
    rng = np.random.default_rng(5)
    v, w = model(rng)
    others = [i for i in range(50) if i != v.end]
    texts = [np.append(rng.choice(others, n), v.end).astype(np.int32) for n in (0, 1, 5, 40, 100, 3, 17, 0, 16, 33)]
    for lanes in (1, 3, 100):
        held = recurrent.Lanes(texts, lanes)
        got = recurrent.Network(w, v.classes, v.end).log_probabilities(held)
        at = 0
        for i in held.order:
            assert np.allclose(got[at : at + len(texts[i])], plain_log(w, v, texts[i]), atol=1e-4)
            at += len(texts[i])
        assert at == len(got)
    assert len(recurrent.Network(w, v.classes, v.end).log_probabilities(recurrent.Lanes([], 3))) == 0


def test_slopes_are_those_of_differences():
    rng = np.random.default_rng(6)
    v, w = model(rng)
    w = {n: a.astype(float) for n, a in w.items()}
    texts = [np.append(rng.integers(8, 50, n), v.end).astype(np.int32) for n in (3, 5, 6, 2)]
    lanes = recurrent.Lanes(texts, 2)
    net = recurrent.Network(w, v.classes, v.end)

    def window():
        kept = []
        states, places, _ = net.steps(lanes, 0, np.zeros((2, 4)), kept)
        return states, lanes.flat[places], kept

    loss = lambda: -sum(sum(plain_log(w, v, t)) for t in texts)
    assert max(lanes.size) <= recurrent.WINDOW  # all of it is one window
    found = {n: np.zeros_like(a) for n, a in w.items()}
    for name, at, slope in net.slopes(*window()):
        found[name][at] += slope
    for name in ("x", "u", "cw", "cb", "ow", "ob"):
        for at in [tuple(rng.integers(0, k) for k in w[name].shape) for _ in range(12)]:
            old = w[name][at]
            w[name][at] = old + 1e-5
            more = loss()
            w[name][at] = old - 1e-5
            less = loss()
            w[name][at] = old
            assert abs((more - less) / 2e-5 - found[name][at]) < 1e-4, (name, at)


def test_averages_are_weighted_and_taken_in_steps(spark):
    rng = np.random.default_rng(7)
    _, like = model(rng)
    parts = [(int(rng.integers(1, 50)), recurrent.packed({n: a + k for n, a in like.items()})) for k in range(70)]
    rows = spark.createDataFrame([(n, bytearray(x), k) for k, (n, x) in enumerate(parts)], "seen long, weights binary, task int")
    got = recurrent.averaged(rows, like)
    shift = sum(n * k for k, (n, _) in enumerate(parts)) / sum(n for n, _ in parts)
    assert all(np.allclose(got[n], a + shift, atol=1e-3) for n, a in like.items())
    assert recurrent.averaged(rows.limit(0), like) is like


def test_every_training_text_is_read_in_one_round(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(400)], "doc_id long, text string")
    turns = [r.t for r in docs.select(recurrent.turn().alias("t")).collect()]
    assert set(turns) == set(range(recurrent.ROUNDS))  # no document is left out
    assert [recurrent.train_lanes(n) for n in (0, 100_000, 10**7)] == [32, 97, 512]


def test_held_out_texts_are_likelier_than_under_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", F.lit(0).alias("score"))
    rows = recurrent.score(docs, share=4).where("held_out").collect()
    n = sum(r.n_tokens for r in rows)
    gain = (sum(r.score for r in rows) - sum(r.base_score for r in rows)) / n
    better = sum(r.score > r.base_score for r in rows) / len(rows)
    assert gain > 0.05 and better > 0.8, (gain, better)
