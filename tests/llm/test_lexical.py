"""Ranked search against scoring every document, with ties, odd rows and early stops."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from packsieve.llm import lexical
from packsieve.llm.resampling import words
from tests.llm.test_operators import SCHEMA, documents


def plain(rows, items, k=10):
    """(item_id, rank, doc_id, score) of (doc_id, text) rows for (item_id, text) queries."""
    docs = [(i, Counter(words(t))) for i, t in rows]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    total, length = len(docs), sum(n for _, _, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = []
    for item_id, text in items:
        asked, found = set(words(text)), []
        for i, c, n in docs:
            m = 10 + 90 * n * total // length
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t in asked & c.keys())
            if score > 0:
                found.append((-score, i is None, i))
        out += [(item_id, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def got(df):
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize(("block", "first"), [((8192, 500_000), 1024), ((7, 10**6), 4), ((10**6, 300), 1)])
def test_ranks_are_those_of_scoring_everything(spark, monkeypatch, block, first):
    monkeypatch.setattr(lexical, "BLOCK_DOCS", block[0])
    monkeypatch.setattr(lexical, "BLOCK_POSTINGS", block[1])
    monkeypatch.setattr(lexical, "FIRST", first)
    docs = documents(spark).repartition(3)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    items = [(1, rows[5][1]), (2, "The THE an er-ti nowhere"), (2, "éthe on, ti"), (3, None), (4, ""), (5, "nowhere"), (None, "日本語 a"), (7, " ".join(t or "" for _, t in rows[20:40]))]
    asked = spark.createDataFrame([(i, t, i, 0) for i, t in items], "item_id long, text string, query long, `rank` int")
    assert got(lexical.search(docs, asked)) == plain(rows, items)
    assert got(lexical.search(docs, asked, 3)) == plain(rows, items, 3)


def test_empty_sides_and_parts(spark, monkeypatch):
    docs, none = documents(spark), spark.createDataFrame([], SCHEMA)
    asked = spark.createDataFrame([("a", "the an"), ("b", "er on é"), ("c", "ti")], "item_id string, text string")
    for d, q in ((none, asked), (docs, asked.limit(0)), (docs, asked.where("item_id = 'x'")), (none, asked.limit(0))):
        assert got(lexical.search(d, q)) == []
    whole = got(lexical.search(docs, asked))
    monkeypatch.setattr(lexical, "PART_TERMS", 1)
    assert got(lexical.search(docs, asked)) == whole and whole


def test_many_equal_scores_go_by_doc_id(spark):
    docs = spark.range(500).select(F.when(F.col("id") != 3, 1000 - F.col("id")).alias("doc_id"), F.when(F.col("id") % 2 == 0, "same words here").otherwise("other words").alias("text"))
    asked = spark.createDataFrame([(1, "same")], "item_id long, text string")
    assert [r.doc_id for r in lexical.search(docs.repartition(4), asked).orderBy("rank").collect()] == list(range(502, 522, 2))


def block_of(rng, n, vocabulary):
    """A block whose terms' frequencies fall off as those of words do."""
    ends, term, tf, length = [], [], [], []
    for _ in range(n):
        c = Counter(min(vocabulary - 1, int(rng.paretovariate(0.6)) - 1) for _ in range(rng.randint(3, 200)))
        term += c.keys()
        tf += c.values()
        length.append(sum(c.values()))
        ends.append(len(term))
    row = {"doc_id": np.arange(n, dtype="<i8"), "missing": np.zeros(n, "u1"), "n": np.array(length, "<i8"), "ends": np.array(ends, "<i4"), "term": np.array(term, "<i4"), "tf": np.array(tf, "<i4")}
    df = np.bincount(row["term"], minlength=vocabulary)
    weight = np.floor(1000 * np.log((2 * n + 2) / (2 * df + 1))).astype(np.int64)
    return lexical.Block({k: v.tobytes() for k, v in row.items()}, weight, n, sum(length)), weight


def test_groups_descend_and_bounds_stop_early(monkeypatch):
    monkeypatch.setattr(lexical, "FIRST", 32)
    rng = random.Random(4)
    block, weight = block_of(rng, 4000, 2000)
    terms = np.array(sorted({0, 1, 2, 3, 10, 30, 100, 300, 700, 1500}))
    groups, bound = block.groups(terms)
    impact = block.group_impact[groups]
    assert (np.diff(impact) <= 0).all() and bound[-1] == 0 and (np.diff(bound) <= 0).all()
    for at in (1, len(groups) // 2, len(groups) - 1):  # the bound is the sum of each term's next impact
        rest = groups[at:]
        assert bound[at - 1] == sum(block.group_impact[rest][block.group_term[rest] == t].max(initial=0) for t in terms)
    every = block.completed(np.arange(4000), terms, len(weight))
    best = np.sort(every)[::-1][:10]
    met, scores, taken = block.best(terms, 10, 0, len(weight))
    postings = int(block.length[groups].sum())
    assert sorted(scores, reverse=True)[:10] == best.tolist() and (every[met] == scores).all() and taken < 0.7 * postings
    met, scores, fewer = block.best(terms, 10, int(best[0]), len(weight))  # a high score known from other blocks
    assert fewer < taken and best[0] in scores
