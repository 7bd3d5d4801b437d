"""Texts that share 0.8 of their five-word shingles, against a plain comparison of all pairs."""

import random
import re
from collections import defaultdict

from packsieve.llm import simhash
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, at int, key string, w0 int"


def plain_shingles(text, words=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def share(a, b):
    return len(a & b) / len(a | b) if a or b else 0.0


def changed(rng, words, n):
    w = list(words)
    for i in rng.sample(range(len(w)), n):
        w[i] = f"new{rng.randint(0, 10**6)}"
    return " ".join(w)


def corpus():
    rng = random.Random(11)
    out, vocabulary = [], [f"word{i}" for i in range(3000)]
    for _ in range(150):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(60, 500))]
        out += [" ".join(words), changed(rng, words, max(1, len(words) // 50))]  # about 0.82
    crowd = [rng.choice(vocabulary) for _ in range(200)]
    out += [changed(rng, crowd, 2) for _ in range(300)]  # any two at about 0.82
    out += [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 300))) for _ in range(300)]
    half = [rng.choice(vocabulary) for _ in range(300)]
    out += [" ".join(half + [rng.choice(vocabulary) for _ in range(120)]) for _ in range(5)]  # a shared passage: about 0.55
    return [None, "", "one two", "One  TWO", "one three", *out, " ".join(out[:40]), " ".join(out[:40]) + " tail"]


def test_similar_texts_are_linked_and_others_are_not(spark):
    texts = corpus()
    docs = spark.createDataFrame([(i, t, 1, "mine", 2) for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r.component_id for r in simhash.cluster(docs).collect()}
    plain = {r.doc_id: r.component_id for r in simhash.cluster(docs, similarity=None).collect()}
    sets = [plain_shingles(t) for t in texts]
    fps = [simhash.fingerprint(t)[0] for t in texts]
    at = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            at[x].append(i)
    met = {(i, j) for ids in at.values() for i in ids for j in ids if i < j}
    near = {(i, j) for i, j in met if share(sets[i], sets[j]) >= 0.8}
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in sorted(near | {(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4}):
        parent[max(find(i), find(j))] = min(find(i), find(j))
    assert all(find(i) == find(c) for i, c in got.items())  # no link but true ones
    found, before = (sum(of[i] == of[j] for i, j in near) / len(near) for of in (got, plain))
    alone = [p for p in near if p[1] == p[0] + 1 and p[0] < 305]
    caught = sum(got[i] == got[j] for i, j in alone) / len(alone)
    assert len(near) > 10_000 and found >= 0.95 and before <= found and len(alone) > 80 and caught >= 0.93
    assert got[3] == 2 and got[4] == 4 and got[0] == got[1] == 0
    kept = simhash.drop(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(got.values())


def prints(spark, texts):
    docs = spark.createDataFrame([(i, t, 0, "", 0) for i, t in enumerate(texts)], SCHEMA)
    rows = simhash.fingerprints(docs, wide=True).withColumnRenamed("text_key", "node").cache()
    return docs, rows


def test_what_is_connected_is_not_compared(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    docs, rows = prints(spark, [changed(rng, words, 1) for _ in range(400)])
    keyed = simhash._print_keys(rows.withColumn("at", F.lit(1).cast("long")))
    assert keyed.count() > 400 and simhash.meeting(keyed).count() == 0
    assert set(simhash.fingerprints(docs).columns) == {"doc_id", "text_key", "fp"}


def test_comparisons_follow_the_rows_of_a_crowd(spark):
    """A crowd of texts any two of which are near, none connected before: comparisons grow as its rows do."""
    made = []
    for n in (300, 900):
        rng = random.Random(n)
        words = [f"w{i}" for i in range(400)]
        _, rows = prints(spark, [changed(rng, words, 5) for _ in range(n)] + [" ".join(rng.choice(words) for _ in range(200)) for _ in range(n)])
        keyed = simhash._print_keys(rows.withColumn("at", F.col("node")))
        met = simhash.meeting(keyed).join(rows.select("node", F.struct(*simhash.PRINT).alias("print")), "node").cache()
        made.append((simhash.to_one_hub(met).count(), simhash.to_hubs(met).count()))
        assert made[-1][0] <= n and made[-1][1] <= keyed.count()
    assert made[0][0] > 200 and made[1][1] <= 4 * made[0][1]


def test_a_shared_passage_makes_no_pairs(spark):
    """Texts that share a long passage and else nothing: they meet under its keys, and next to none are compared."""
    rng = random.Random(8)
    passage = [f"p{i}" for i in range(120)]
    texts = [" ".join([*(f"a{rng.randint(0, 10**6)}" for _ in range(60)), *passage, *(f"b{rng.randint(0, 10**6)}" for _ in range(60))]) for _ in range(600)]
    _, rows = prints(spark, texts)
    met = simhash.meeting(simhash._print_keys(rows.withColumn("at", F.col("node")))).join(rows.select("node", F.struct(*simhash.PRINT).alias("print")), "node").cache()
    made = (met.count(), simhash.to_hubs(met).count(), simhash.among(met).count())
    assert made[0] > 2000 and max(made[1:]) < len(texts), made


def test_recall_in_every_band_of_similarity(spark):
    """Texts and one copy of each with scattered changes, so that nothing but the pair itself connects them."""
    rng = random.Random(21)
    vocabulary = [f"word{i}" for i in range(5000)]
    texts, pairs = [], []
    for _ in range(1100):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(60, 600))]
        copy = changed(rng, words, max(1, round(len(words) * rng.uniform(0.002, 0.024))))
        a, b = plain_shingles(" ".join(words)), plain_shingles(copy)
        if (s := share(a, b)) >= 0.8:
            pairs.append((len(texts), s))
            texts += [" ".join(words), copy]
    docs = spark.createDataFrame([(i, t, 1, "mine", 2) for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r.component_id for r in simhash.cluster(docs).collect()}
    for low, high in ((0.8, 0.82), (0.82, 0.84), (0.84, 0.87), (0.87, 0.9), (0.9, 0.95), (0.95, 1.01)):
        band = [got[i] == got[i + 1] for i, s in pairs if low <= s < high]
        print(low, len(band), sum(band) / len(band))
        assert len(band) >= 40 and sum(band) >= 0.93 * len(band), (low, len(band), sum(band) / len(band))


def test_no_rows_and_texts_without_words(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert simhash.cluster(none).count() == simhash.drop(none).count() == 0
    empty = spark.createDataFrame([(3, " ", 0, "", 0), (None, None, 0, "", 0), (1, "", 0, "", 0)], SCHEMA)
    assert {(r.doc_id, r.component_id) for r in simhash.cluster(empty).collect()} == {(3, 1), (None, 1), (1, 1)}


def test_a_crowd_of_edited_copies_is_not_compared_pair_by_pair(spark, monkeypatch):
    """Copies of one text, each with edits of its own, most pairs below the limit: as linked as all pairs would be, from few comparisons."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    texts = [changed(rng, base, rng.choice((1, 2, 3, 4, 5, 6))) for _ in range(260)]
    for _ in range(8):  # far from the rest, near one another
        far = changed(rng, base, 8).split()
        texts += [changed(rng, far, rng.choice((1, 2, 3))) for _ in range(5)]
    sets = [plain_shingles(t) for t in texts]
    near = [(i, j) for i in range(len(texts)) for j in range(i) if share(sets[i], sets[j]) >= 0.8]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    fps = [simhash.fingerprint(t)[0] for t in texts]
    for i, j in [*near, *((i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4)]:
        parent[max(find(i), find(j))] = min(find(i), find(j))

    docs = spark.createDataFrame([(i, t, 0, "", 0) for i, t in enumerate(texts)], SCHEMA)
    id_of = {r.k: r.doc_id for r in docs.select("doc_id", simhash.text_key(F.col("text")).alias("k")).collect()}
    node_of = {i: k for k, i in id_of.items()}

    # one crowd of all of them: exact, whatever keys they share
    nodes = docs.select(simhash.text_key(F.col("text")).alias("node")).cache()
    told = simhash.differences(nodes.select(F.lit(1).cast("long").alias("crowd"), "node"), simhash.shingle_sets(docs, nodes, 4), 0.8)
    star = {(id_of[r.a], id_of[r.b]) for r in simhash.to_middle(told).collect()}
    at = spark.createDataFrame([(node_of[i], i) for i in range(len(texts))], "node long, at long")
    rare = {(id_of[r.a], id_of[r.b]) for r in simhash.of_rare(simhash.rare_differences(told), at).collect()}
    linked = {frozenset(p) for p in star | rare}
    middle = {a for a, _ in star}.pop()
    reached = {b for _, b in star} | {middle}
    assert all(share(sets[a], sets[b]) >= 0.8 for a, b in star) and len(reached) > 50
    assert all(frozenset(p) in linked or set(p) <= reached for p in near)

    asked, confirmed = [], simhash.confirmed
    monkeypatch.setattr(simhash, "confirmed", lambda pairs, *more: asked.append(pairs.count()) or confirmed(pairs, *more))
    got = {r.doc_id: r.component_id for r in simhash.cluster(docs).collect()}
    assert all(find(i) == find(c) for i, c in got.items())
    assert sum(got[i] == got[j] for i, j in near) >= 0.98 * len(near)
    assert len(near) > 1000 and asked[-1] < len(texts) and sum(asked) < 25 * len(texts), (len(near), asked)
