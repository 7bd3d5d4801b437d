"""Operator 12: ranked lexical search, score at a time over impact-ordered postings.

Index. Documents are dealt into blocks of bounded size as a task reads them. A block holds
its documents' lengths and the counts of their terms, as far as a query asks for them; its
rows are a written table. Document counts and lengths come from all blocks, so that every
posting has its exact impact: the integer that a term adds to a document's score.

Search. In a block the postings of each term are grouped by exact impact. For each query
the groups of its terms are taken in descending order of impact, some more at each
step, and added to the documents' sums. Of a term, no more than the impact of its
next group can follow; the sum of these bounds over the query's terms is what a
document can still gain. Groups are taken until that sum is below the k-th best score
known (of earlier blocks of the same task, or of this block's sums so far): then no
document that was not met can enter the best k. Those that were met and may still
enter get their scores completed from their own terms. Each task keeps k documents for
a query over all its blocks and sends these on; Spark ranks them.

All is exact; work on a query follows the groups that its bounds ask for. Queries are
sent to the tasks in parts of about ``PART_TERMS`` terms, all documents being read for
each part, so what is broadcast is bounded.

Edge cases: null or wordless texts are no documents (in N, L or a result), and null or
wordless queries have no result; a null doc_id comes last among equal scores; rows that
repeat a doc_id are documents of their own, rows that repeat an item_id queries of their
own; terms that no document holds add nothing; documents of score 0 are left out; an
empty table on either side gives no rows; extra columns are dropped, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packsieve.llm import scratch
from packsieve.llm.resampling import words

TOP = 10
#: Documents and postings of a block, about; query terms sent to tasks at a time.
BLOCK_DOCS, BLOCK_POSTINGS, PART_TERMS = 8192, 500_000, 2_000_000
#: Postings taken in the first step; each further step takes this many times as many as the one before.
FIRST, GROW = 1024, 2
BLOCK = "docs long, terms long, doc_id binary, missing binary, n binary, ends binary, term binary, tf binary"


class _Codes(dict):
    """A term's number, -1 for others."""

    def __missing__(self, term: bytes) -> int:
        return -1


def blocks(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """``BLOCK``: documents with at least one term, with the counts of those terms that are in the vocabulary."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _Codes((w, i) for i, w in enumerate(sent.value))
        ids, missing, n, ends, term, tf = [], [], [], [], [], []

        def block() -> pa.RecordBatch:
            columns = [(ids, "<i8"), (missing, "u1"), (n, "<i8"), (ends, "<i4"), (term, "<i4"), (tf, "<i4")]
            row = [pa.array([len(ids)]), pa.array([sum(n)]), *[pa.array([np.array(c, dtype=kind).tobytes()]) for c, kind in columns]]
            for c, _ in columns:
                c.clear()
            return pa.RecordBatch.from_arrays(row, [x.split()[0] for x in BLOCK.split(", ")])

        for batch in batches:
            of = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
            for doc_id, text in zip(of["doc_id"].to_pylist(), of["text"], strict=True):
                if not (own := words(text.as_py())):
                    continue
                counts = Counter(map(codes.__getitem__, own))
                counts.pop(-1, None)
                ids.append(doc_id or 0)
                missing.append(doc_id is None)
                n.append(len(own))
                term += counts.keys()
                tf += counts.values()
                ends.append(len(term))
                if len(ids) >= BLOCK_DOCS or len(term) >= BLOCK_POSTINGS:
                    yield block()
        if ids:
            yield block()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(build, BLOCK)


def document_counts(held: DataFrame, size: int) -> np.ndarray:
    """In how many documents each term of the vocabulary is."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            for x in batch.column(0):
                total += np.bincount(np.frombuffer(x.as_py(), "<i4"), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["term", "n"])

    out = np.zeros(size, dtype=np.int64)
    for r in held.select("term").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():  # a row for each query term at most
        out[r.term] = r.n
    return out


class Block:
    """The postings of a block, by document and, grouped by exact impact, by term."""

    def __init__(self, row: dict[str, bytes], weight: np.ndarray, documents: int, terms: int):
        read = {k: np.frombuffer(row[k], kind) for k, kind in (("doc_id", "<i8"), ("missing", "u1"), ("n", "<i8"), ("ends", "<i4"), ("term", "<i4"), ("tf", "<i4"))}
        self.doc_id, self.missing, self.term = read["doc_id"], read["missing"], read["term"].astype(np.int64)
        self.size = len(self.doc_id)
        self.ends = read["ends"].astype(np.int64)
        owner = np.repeat(np.arange(self.size), np.diff(self.ends, prepend=0))
        m = 10 + np.array([90 * x * documents // terms for x in read["n"].tolist()], dtype=np.int64)  # of any size, so Python's numbers
        tf = read["tf"].astype(np.int64)
        self.impact = weight[self.term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[owner]))
        order = np.lexsort((-self.impact, self.term))
        self.owner = owner[order]
        term, impact = self.term[order], self.impact[order]
        #: Groups: where each begins among the ordered postings, its term and impact; and where each term's groups begin.
        self.begin = np.flatnonzero(np.concatenate([[True], (np.diff(term) != 0) | (np.diff(impact) != 0)])) if len(term) else np.zeros(0, np.int64)
        self.length = np.diff(self.begin, append=len(term))
        self.group_impact = impact[self.begin]
        self.group_term = term[self.begin]

    def groups(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(groups of these terms in descending order of impact, what the query's other groups can add to a document once so many are taken)."""
        lo, hi = np.searchsorted(self.group_term, terms), np.searchsorted(self.group_term, terms, side="right")
        size = hi - lo
        at = np.arange(size.sum()) + np.repeat(lo - (np.cumsum(size) - size), size)
        last = np.zeros(len(at), bool)
        last[np.cumsum(size)[size > 0] - 1] = True
        # taking a group lowers its term's bound to the next group's impact
        step = self.group_impact[at] - np.where(last, 0, self.group_impact[np.minimum(at + 1, len(self.group_impact) - 1)]) if len(at) else self.group_impact[at]
        order = np.argsort(-self.group_impact[at], kind="stable")
        bound = self.group_impact[lo[size > 0]].sum() - np.cumsum(step[order])
        return at[order], bound

    def completed(self, docs: np.ndarray, terms: np.ndarray, size: int) -> np.ndarray:
        """The scores of these documents, from their own terms."""
        asked = np.zeros(size, bool)
        asked[terms] = True
        first = np.concatenate([[0], self.ends])[docs]
        length = self.ends[docs] - first
        at = np.arange(length.sum()) + np.repeat(first - (np.cumsum(length) - length), length)
        sums = np.concatenate([[0], np.cumsum(np.where(asked[self.term[at]], self.impact[at], 0))])
        stop = np.cumsum(length)
        return sums[stop] - sums[stop - length]

    def best(self, terms: np.ndarray, k: int, known: int, size: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(documents, scores, postings taken): all that may be among the best ``k``, where ``known`` is the k-th score known before (0: none)."""
        groups, bound = self.groups(terms)
        sums, taken, at, most = np.zeros(self.size, dtype=np.int64), 0, 0, FIRST
        reach = np.cumsum(self.length[groups])
        threshold, rest = known, int(bound[0] + self.group_impact[groups[0]]) if len(groups) else 0  # before the first group
        while at < len(groups) and not (threshold and rest < threshold):
            to = max(at + 1, int(np.searchsorted(reach, taken + most, side="right")))
            part = groups[at:to]
            length = self.length[part]
            where = np.arange(length.sum()) + np.repeat(self.begin[part] - (np.cumsum(length) - length), length)
            # sums of integers below 2 ** 53 are exact in doubles
            sums += np.bincount(self.owner[where], weights=np.repeat(self.group_impact[part], length), minlength=self.size).astype(np.int64)
            taken, at, most, rest = int(reach[to - 1]), to, most * GROW, int(bound[to - 1])
            if self.size >= k:
                threshold = max(known, int(np.partition(sums, self.size - k)[self.size - k]))
        met = np.flatnonzero((sums > 0) & (sums + rest >= threshold))
        scores = self.completed(met, terms, size) if rest else sums[met]
        return met, scores, taken


def _asked(items: DataFrame) -> list[tuple]:
    """(item_id, different terms) of each query, on the driver: one part of the stated queries."""
    return [(r[0], sorted(set(words(r[1])))) for r in items.collect()]


def _part(docs: DataFrame, items: list[tuple], kind: str, k: int) -> DataFrame | None:
    """(query number, item_id, doc_id, score): the best ``k`` of each task for each query."""
    spark = docs.sparkSession
    vocabulary = sorted({t for _, terms in items for t in terms})
    if not vocabulary:
        return None
    held = scratch.table(blocks(docs, vocabulary), "blocks")
    total = held.agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("n"), F.coalesce(F.sum("terms"), F.lit(0)).alias("l")).first()
    if not total.n:
        return None
    df = document_counts(held, len(vocabulary))
    weight = np.floor(1000 * np.log((2 * total.n + 2) / (2 * df + 1))).astype(np.int64)
    code = {t: i for i, t in enumerate(vocabulary)}
    queries = [np.array([c for t in terms if df[c := code[t]] and weight[c]], dtype=np.int64) for _, terms in items]
    sent = spark.sparkContext.broadcast((weight, queries))
    documents, length = total.n, total.l

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, queries = sent.value
        best: list[list[tuple]] = [[] for _ in queries]  # (-score, no id, id), the best k of this task so far
        for batch in batches:
            for i in range(batch.num_rows):
                block = Block({name: batch.column(c)[i].as_py() for c, name in enumerate(batch.schema.names)}, weight, documents, length)
                for q, terms in enumerate(queries):
                    mine = best[q]
                    met, scores, _ = block.best(terms, k, -mine[k - 1][0] if len(mine) >= k else 0, len(weight))
                    if len(met):
                        best[q] = sorted([*mine, *zip((-scores).tolist(), block.missing[met].tolist(), block.doc_id[met].tolist(), strict=True)])[:k]
        rows = [(q, None if missing else doc_id, -score) for q, mine in enumerate(best) for score, missing, doc_id in mine]
        columns = [pa.array([r[c] for r in rows], kind) for c, kind in enumerate((pa.int32(), pa.int64(), pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["query", "doc_id", "score"])

    found = scratch.dealt(held.select("doc_id", "missing", "n", "ends", "term", "tf")).mapInArrow(search, "query int, doc_id long, score long")
    names = spark.createDataFrame([(q, item_id) for q, (item_id, _) in enumerate(items)], f"query int, item_id {kind}")
    return found.join(F.broadcast(names), "query")


def search(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """item_id, rank int, doc_id, score long: the best ``k`` documents (doc_id, text) for each row of ``items`` (item_id, text)."""
    kind = items.schema["item_id"].dataType.simpleString()
    asked = items.select("item_id", F.col("text").cast("string").alias("text"))
    characters = asked.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-characters // (6 * PART_TERMS)))  # a term takes six characters or so
    out = None
    for p in range(parts):
        found = _part(docs, _asked(asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == p)), kind, k)
        if found is not None:
            found = found.withColumn("part", F.lit(p))
            out = found if out is None else out.unionByName(found)
    if out is None:
        return docs.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    order = Window.partitionBy("part", "query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
