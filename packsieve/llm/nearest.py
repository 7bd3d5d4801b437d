"""Operator 7: approximate nearest neighbours by balanced posting lists.

Nearness is the inner product. Vectors get one more component, the root of the
largest squared norm less their own, so that the nearest in distance are those
with the largest product. A bounded sample is halved again and again at the
median along its main direction, which gives clusters of equal size; their means
are the centroids, at most ``CENTROIDS``. The centroids and a graph of their
nearest neighbours are held in memory (bounded, so broadcast). A vector goes to
its nearest centroid's posting list, and a boundary vector also to each list
whose centroid is at most ``CLOSURE`` times as far (``COPIES`` at most). A query
reads the lists found by the same graph search whose distance is at most
``REACH`` times the nearest (at most ``LISTS``, or ``SHARE`` of all where that is
more), so easy queries read few. The ratio prunes only after the nearest ``LEAST``
lists, and after lists that own at least ``SPARE`` times the vectors asked for (each
vector is owned by its nearest list alone). A query that found fewer than asked for
all the same (of repeated rows, say) is run again over all lists.

A list is dealt over as many cells as its size asks for, and the queries that read it
over blocks, so a list swollen by copies of one vector is no hot task; each cell keeps
its best different ids per query, ties to
the smaller id included, and cells are merged by query. Scores are computed on the
original vectors in double precision.

The index is fitted on a sample of at most ``SAMPLE`` vectors and ``NUMBERS`` components
(18 MB); all vectors are indexed. Up to ``CENTROIDS`` times ``POSTING`` vectors (1.6 million)
lists keep their length; beyond, they grow with the table. Vectors without any clusters need
the share ``SHARE`` of all lists for a recall of 0.9; of clustered ones the ratio reads few lists. Recall is measured
against brute force in the tests and stated in the README.

Edge cases: vectors that are null, zero, or hold null or non-finite components
take no part; rows that repeat a vec_id count once, with the best score (a
query's own id is left out); fewer candidates than asked for give shorter lists; vectors and
queries of another length than the vectors' most frequent one (ties: the smaller) take no
part; extra columns are dropped; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packsieve.llm import scratch

SAMPLE, NUMBERS, CENTROIDS, POSTING = 32_768, 2_200_000, 8192, 200
DEGREE, FAR, BEAM, NARROW = 24, 8, 64, 24
CLOSURE, COPIES = 1.08, 4
REACH, LISTS, SHARE = 1.15, 64, 5 / 32
LEAST, SPARE = 8, 4
CELL, ASKS, K = 2000, 4096, 20


@dataclass
class Index:
    centroids: np.ndarray
    graph: np.ndarray
    entries: np.ndarray
    norm2: float


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (array of double) of the vectors that take part."""
    e = F.col("embedding").cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("embedding")).where(
        F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.exists("embedding", bad) & F.exists("embedding", lambda x: x != 0)
    )


def lifted(x: np.ndarray, norm2: float) -> np.ndarray:
    """The vectors with the component that makes all norms equal."""
    return np.hstack([x, np.sqrt(np.maximum(norm2 - (x * x).sum(axis=1), 0))[:, None]])


def halve(points: np.ndarray, leaves: int) -> list[np.ndarray]:
    """Equal-sized clusters: median cuts along the main direction of each part."""
    parts = [points]
    while len(parts) < leaves:
        after = []
        for p in parts:
            if len(p) < 2:
                after.append(p)
                continue
            centred = p - p.mean(axis=0)
            v = np.ones(p.shape[1]) / p.shape[1] ** 0.5 + centred[0]
            for _ in range(15):
                v = centred.T @ (centred @ v)
                v /= max(np.linalg.norm(v), 1e-12)
            order = np.argsort(centred @ v, kind="stable")
            after += [p[order[: len(p) // 2]], p[order[len(p) // 2 :]]]
        if len(after) == len(parts):
            break
        parts = after
    return parts


def closest(points: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
    """The n nearest of c for each point, nearest first, some points at a time."""
    square, out = (c**2).sum(axis=1), []
    for at in range(0, len(points), 1024):
        far = square - 2 * points[at : at + 1024] @ c.T
        out.append(far.argmin(axis=1)[:, None] if n == 1 else np.argsort(far, axis=1, kind="stable")[:, :n])
    return np.concatenate(out)


def build(sample: np.ndarray, total: int, norm2: float) -> Index:
    points = np.unique(lifted(sample, norm2), axis=0)
    leaves = 1 << max(0, int(np.ceil(np.log2(max(1, min(CENTROIDS, total / POSTING, len(points) / 4))))))
    c = np.stack([p.mean(axis=0) for p in halve(points, leaves)])
    for _ in range(5):  # Lloyd steps move the means, which starts them from equal sizes
        own = closest(points, c, 1)[:, 0]
        for k in np.unique(own):
            c[k] = points[own == k].mean(axis=0)
    near = closest(c, c, DEGREE + 1)[:, 1:]
    rng = np.random.default_rng(0)
    graph = np.zeros((1, 1), int)
    if len(c) > 1:
        # some far links make the graph one piece; one that is there already points to its own centroid, which adds nothing
        far, own = rng.integers(0, len(c), (len(c), FAR)), np.arange(len(c))[:, None]
        for j in range(FAR):
            there = (np.hstack([near, far[:, :j]]) == far[:, j : j + 1]).any(axis=1)
            far[there, j] = own[there, 0]
        graph = np.hstack([near, far])
    return Index(c, graph, rng.choice(len(c), min(len(c), 8), replace=False), norm2)


def search(index: Index, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search of the centroid graph, many queries side by side: (centroids, distances), nearest first."""
    n, c = len(q), index.centroids
    beam = min(beam, len(c))
    seen = np.zeros((n, len(c)), bool)
    ids = np.tile(index.entries, (n, 1))
    seen[np.arange(n)[:, None], ids] = True
    square = (c**2).sum(axis=1)
    measure = lambda rows, cand: np.sqrt(np.maximum(((q[rows] ** 2).sum(1)[:, None] + square[cand] - 2 * np.einsum("nd,nkd->nk", q[rows], c[cand])), 0))
    dist = measure(np.arange(n), ids)
    done = np.zeros(ids.shape, bool)
    rows = np.arange(n)
    while len(rows):
        pick = np.where(done[rows], np.inf, dist[rows]).argmin(axis=1)
        open_ = ~done[rows, pick] & np.isfinite(dist[rows, pick])
        rows, pick = rows[open_], pick[open_]
        if not len(rows):
            break
        done[rows, pick] = True
        cand = index.graph[ids[rows, pick]]
        fresh = ~seen[rows[:, None], cand]
        seen[rows[:, None], cand] = True
        d = np.where(fresh, measure(rows, cand), np.inf)
        width = max(beam, ids.shape[1])
        all_ids, all_d = np.hstack([ids[rows], cand]), np.hstack([dist[rows], d])
        all_done = np.hstack([done[rows], np.zeros(cand.shape, bool)])
        best = np.argsort(all_d, axis=1, kind="stable")[:, :width]
        if ids.shape[1] < width:
            grow = min(width, all_ids.shape[1]) - ids.shape[1]
            ids = np.hstack([ids, np.zeros((n, grow), ids.dtype)])
            dist = np.hstack([dist, np.full((n, grow), np.inf)])
            done = np.hstack([done, np.zeros((n, grow), bool)])
            best = best[:, : ids.shape[1]]
        take = np.arange(len(rows))[:, None]
        ids[rows], dist[rows], done[rows] = all_ids[take, best], all_d[take, best], all_done[take, best]
        rows = rows[(~done[rows] & np.isfinite(dist[rows])).any(axis=1)]
    order = np.argsort(dist, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)


def dimension(vectors: DataFrame) -> int:
    """The most frequent length of the vectors, ties to the smaller; 0 where there are none."""
    first = vectors.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return first.d if first else 0


def fit(vectors: DataFrame, dim: int) -> Index | None:
    """The index of a bounded sample: rows whose hash is below a threshold that gives about ``SAMPLE`` of them, or ``NUMBERS`` components."""
    facts = vectors.agg(F.count("*").alias("n"), F.max(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)).alias("norm2")).first()
    if not facts.n:
        return None
    most = max(1, min(SAMPLE, NUMBERS // dim))
    share = min(1.0, most / facts.n)
    picked = vectors.where(F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).select("embedding")
    sample = np.stack(picked.limit(2 * most).toPandas().embedding.to_numpy())
    return build(sample, facts.n, facts.norm2) if len(sample) else None


def assigned(rows: DataFrame, index: Index, ratio: float, most: int, id_name: str, owned: np.ndarray | None = None, need: int = 0) -> DataFrame:
    """``rows`` with the lists chosen for each: (list, id_name, embedding, own: whether it is the nearest).

    With ``owned``, the vectors that each list owns, rows are queries, and the lists chosen own at least ``need`` where so many are in reach.
    """
    held, query = rows.sparkSession.sparkContext.broadcast(index), owned is not None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), 2048):
                batch = whole.iloc[at : at + 2048]
                x = np.stack(batch.embedding.to_numpy())
                # a query's own length does not change the order of its products: it is scaled to the largest
                scale = np.sqrt(held.value.norm2) / np.linalg.norm(x, axis=1, keepdims=True)
                q = np.hstack([x * scale, np.zeros((len(x), 1))]) if query else lifted(x, held.value.norm2)
                ids, dist = search(held.value, q, max(BEAM, most) if query else max(NARROW, 4 * most))
                ids, dist = ids[:, :most], dist[:, :most]
                chosen = np.isfinite(dist) & (dist <= ratio * dist[:, :1] + 1e-12)
                chosen[:, 0] = True
                if query:
                    before = np.cumsum(owned[ids], axis=1) - owned[ids]
                    chosen |= np.isfinite(dist) & ((np.arange(ids.shape[1]) < LEAST) | (before < need))
                row, col = np.nonzero(chosen)
                yield pd.DataFrame({"list": ids[row, col].astype(np.int64), id_name: batch.vec_id.to_numpy()[row], "embedding": batch.embedding.to_numpy()[row], "own": col == 0})

    return rows.mapInPandas(run, f"list long, {id_name} long, embedding array<double>, own boolean")


def best_of(query_id: np.ndarray, q: np.ndarray, vec_id: np.ndarray, v: np.ndarray, k: int) -> Iterator[pd.DataFrame]:
    """The k best different vec_ids of v for each query, its own left out; ties to the smaller id.

    A matrix product finds candidates; their products are summed again row by row, in one order.
    """
    once, spare = len(np.unique(vec_id)) == len(vec_id), 2 * k + 8
    for at in range(0, len(q), 256):
        part, own = q[at : at + 256], query_id[at : at + 256]
        rough = part @ v.T
        if len(v) > spare and once:
            spot = np.argpartition(-rough, spare, axis=1)[:, : spare + 1]
            near = np.take_along_axis(rough, spot, 1)
            # the last candidate is worse than k others for certain: what was left out is no better
            floor = np.sort(near, axis=1)
            clear = floor[:, -(k + 1)] - floor[:, 0] > 1e-9 * np.maximum(1.0, np.abs(floor[:, 0]))
        else:
            spot, clear = np.tile(np.arange(len(v)), (len(part), 1)), np.zeros(len(part), bool)
        rows = np.flatnonzero(clear)
        if len(rows):
            ids = vec_id[spot[rows]]
            score = (v[spot[rows]] * part[rows, None, :]).sum(axis=2)
            score[ids == own[rows, None]] = -np.inf
            order = np.lexsort((ids, -score), axis=1)[:, :k]
            take = np.take_along_axis
            yield pd.DataFrame({"query_id": np.repeat(own[rows], k), "vec_id": take(ids, order, 1).ravel(), "score": take(score, order, 1).ravel()})
        for i in np.flatnonzero(~clear):
            score = (v * part[i]).sum(axis=1)
            order = np.lexsort((vec_id, -score))
            order = order[vec_id[order] != own[i]]
            if not once:  # of a repeated id, its best row
                _, first = np.unique(vec_id[order], return_index=True)
                order = order[np.sort(first)]
            yield pd.DataFrame({"query_id": own[i], "vec_id": vec_id[order[:k]], "score": score[order[:k]]})


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id long, rank int from 1, vec_id long, score double. Both tables: vec_id, embedding."""
    spark = vectors.sparkSession
    base = scratch.table(usable(vectors), "vectors")
    dim = dimension(base)
    base = base.where(F.size("embedding") == dim)
    index = fit(base, dim)
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    row = F.monotonically_increasing_id().alias("row")
    postings = scratch.table(assigned(base, index, CLOSURE, COPIES, "vec_id").select("*", row), "postings")
    lists = postings.groupBy("list").agg(F.count("*").alias("n"), F.count_if("own").alias("own")).collect()  # a row per centroid
    owned = np.zeros(len(index.centroids), dtype=np.int64)
    owned[[r.list for r in lists]] = [r.own for r in lists]
    cells = spark.createDataFrame([(r.list, -(-r.n // CELL)) for r in lists], "list long, cells long")
    asking = usable(queries).where(F.size("embedding") == dim).dropDuplicates()
    probes = assigned(asking, index, REACH, max(LISTS, int(SHARE * len(index.centroids))), "query_id", owned, SPARE * (k + 1)).drop("own")

    def cell(asks: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        if not len(asks) or not len(there):
            return none
        v = np.stack(there.embedding.to_numpy())
        return pd.concat([none, *best_of(asks.query_id.to_numpy(), np.stack(asks.embedding.to_numpy()), there.vec_id.to_numpy(), v, k)])

    def met(probes: DataFrame) -> DataFrame:
        probes = scratch.table(probes.select("*", row), "probes")
        asks = probes.groupBy("list").agg(F.ceil(F.count("*") / ASKS).alias("blocks"))  # a row per centroid
        facts = F.broadcast(cells.join(F.broadcast(asks), "list"))
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        block = F.pmod(F.xxhash64("query_id", "row"), F.col("blocks")).alias("block")
        asked = probes.join(facts, "list").select("list", block, every("cells").alias("cell"), "query_id", "embedding")
        # by row too: a vec_id that is repeated very often fills more than one cell
        held = postings.join(facts, "list").select("list", F.pmod(F.xxhash64("vec_id", "row"), F.col("cells")).alias("cell"), every("blocks").alias("block"), "vec_id", "embedding")
        keys = ["list", "cell", "block"]
        found = asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(cell, "query_id long, vec_id long, score double")
        # a boundary vector is found in several lists, with one and the same score
        return found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    once = scratch.table(met(probes), "found")
    full = once.groupBy("query_id").count().where(F.col("count") >= k).select("query_id")
    short = scratch.table(asking.withColumnRenamed("vec_id", "query_id").join(full, "query_id", "left_anti"), "short")
    if short.limit(1).count():
        everywhere = F.explode(F.array(*[F.lit(r.list).cast("long") for r in lists]))
        again = met(short.select(everywhere.alias("list"), "query_id", "embedding"))
        once = once.join(full, "query_id", "left_semi").unionByName(again)
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
