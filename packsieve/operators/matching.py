"""Candidate predicates against labelled frames: sets, metrics, verdicts, traces.

Many candidates are evaluated in one scan of the frames. What is shuffled are
counts per (probe, candidate) or the frames that match, never all frames.
Candidates are projected ``BATCH`` at a time, so generated code stays small.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packsieve.operators import columns
from packsieve.operators.predicates import Field, Leaf, Tree, children, leaves
from packsieve.operators.predicates import Both, Neither

BATCH = 50
# Limits of a trace.
TRACE_PATHS, TRACE_CALLS, TRACE_FRAMES, TRACE_CELLS = 64, 64, 1024, 65_536


def batches(items: Sequence, size: int = BATCH) -> list[Sequence]:
    return [items[i : i + size] for i in range(0, len(items), size)]


def union(parts: Sequence[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, parts)


def matches(frames: DataFrame, trees: Mapping[str, Tree], catalog: Mapping[str, Field], keys: Sequence[str] = ("probe_id", "frame")) -> DataFrame:
    """A row (keys, candidate) for every frame that a candidate selects."""

    def one(batch: Sequence[str]) -> DataFrame:
        hit = [F.when(columns.column(trees[c], catalog), F.lit(c)) for c in batch]
        pushed = [columns.pushable(trees[c], catalog) for c in batch]
        rows = frames
        if all(p is not None for p in pushed):  # a frame that no candidate can select need not be read
            rows = rows.where(functools.reduce(lambda a, b: a | b, pushed))
        return rows.select(*keys, F.explode(F.array_compact(F.array(*hit))).alias("candidate"))

    return union([one(b) for b in batches(list(trees))])


def counts(frames: DataFrame, trees: Mapping[str, Tree], expected: Mapping[str, Column] | Column, catalog: Mapping[str, Field], probe: str = "probe_id") -> DataFrame:
    """E1, E2 as counts: (probe, candidate, n_expected, n_candidate, n_both), one partial aggregate over one scan.

    ``expected`` is one label column or one for each candidate.
    """

    def one(batch: Sequence[str]) -> DataFrame:
        aggs = []
        for i, c in enumerate(batch):
            label = expected[c] if isinstance(expected, Mapping) else expected
            hit = columns.column(trees[c], catalog)
            aggs += [F.count_if(label).alias(f"e{i}"), F.count_if(hit).alias(f"c{i}"), F.count_if(label & hit).alias(f"b{i}")]
        wide = frames.groupBy(probe).agg(*aggs)
        rows = F.array(*[
            F.struct(F.lit(c).alias("candidate"), F.col(f"e{i}").alias("n_expected"), F.col(f"c{i}").alias("n_candidate"), F.col(f"b{i}").alias("n_both"))
            for i, c in enumerate(batch)
        ])
        return wide.select(probe, F.inline(rows))

    return union([one(b) for b in batches(list(trees))])


def with_metrics(df: DataFrame) -> DataFrame:
    """reference_only, candidate_only, precision, recall, f1, jaccard, exact, empty_coincidence.

    Empty sets: precision is 1 if both are empty and 0 if only the candidate's
    is; recall 1 if both are, 0 if only the expected; jaccard 1 for an empty union.
    """
    e, c, b = (F.col(n).cast("double") for n in ("n_expected", "n_candidate", "n_both"))
    p = F.when(c > 0, b / c).when(e == 0, 1.0).otherwise(0.0)
    r = F.when(e > 0, b / e).when(c == 0, 1.0).otherwise(0.0)
    return (
        df.withColumn("reference_only", F.col("n_expected") - F.col("n_both"))
        .withColumn("candidate_only", F.col("n_candidate") - F.col("n_both"))
        .withColumn("precision", p).withColumn("recall", r)
        .withColumn("f1", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0))
        .withColumn("jaccard", F.when(e + c - b > 0, b / (e + c - b)).otherwise(1.0))
        .withColumn("exact", (F.col("reference_only") == 0) & (F.col("candidate_only") == 0))
        .withColumn("empty_coincidence", (F.col("n_expected") == 0) & (F.col("n_candidate") == 0))
    )


def macro(metrics: DataFrame, keys: Sequence[str], runtime: str | None = None) -> DataFrame:
    """E5: means over probes, exact probes, and nearest-rank p50 and p95 of a runtime column."""
    aggs = [F.count("*").alias("probes"), F.count_if("exact").alias("exact_probes")]
    aggs += [F.avg(m).alias(f"macro_{m}") for m in ("precision", "recall", "f1", "jaccard")]
    if runtime:
        aggs += [F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {runtime})").alias(f"{runtime}_p{int(100 * p)}") for p in (0.5, 0.95)]
    return metrics.groupBy(*keys).agg(*aggs)


def verdict(
    completed: Column, parsed: Column, ready: Column, gold_ready: Column, error_code: Column, shortcut: Column, exact_everywhere: Column, some_expected: Column
) -> Column:
    """One of eight outcomes; the order of the tests is the rule.

    A candidate that is exact on every probe is strong only if some probe expects a frame.
    """
    return (
        F.when(~completed, "provider_failed")
        .when(~parsed, "malformed")
        .when(~ready, "abstained")
        .when(~gold_ready, "false_ready")
        .when(error_code.isNotNull(), "invalid")
        .when(exact_everywhere & some_expected & shortcut, "shortcut")
        .when(exact_everywhere & some_expected, "strong_exact")
        .otherwise("silent_wrong")
    )


def over_probes(metrics: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Exact on every probe, and whether any expects a frame."""
    return metrics.groupBy(*keys).agg(F.bool_and("exact").alias("exact_everywhere"), F.bool_or(F.col("n_expected") > 0).alias("some_expected"), F.count("*").alias("probes"))


def difference(expected: DataFrame, candidate: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every key of either side with where it is: 'both', 'reference_only' or 'candidate_only'."""
    a = expected.select(*keys).distinct().withColumn("_a", F.lit(True))
    b = candidate.select(*keys).distinct().withColumn("_b", F.lit(True))
    side = F.when(F.col("_a") & F.col("_b"), "both").when(F.col("_a"), "reference_only").otherwise("candidate_only")
    return a.join(b, list(keys), "full").select(*keys, side.alias("side"))


def signatures(selected: DataFrame, key: str, probe: str = "probe_id", frame: str = "frame") -> DataFrame:
    """A3: (key, n, signature): a fingerprint of the frames that each candidate selects, whatever the order of rows.

    Of each probe the count, the sum and the exclusive or of 64-bit hashes of its frames: partial
    aggregates of three numbers, so no set is collected and a candidate with a third of all rows
    is no hot task. ``selected``: key, probe, frame, each once. What selects nothing has no row.
    """
    h = F.xxhash64(frame)
    per = selected.groupBy(key, probe).agg(F.count("*").alias("n"), F.sum(h.cast("decimal(20,0)")).alias("sum"), F.bit_xor(h).alias("xor"))
    return per.groupBy(key).agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct(probe, "n", "sum", "xor"))).alias("signature"))


def same_frames(a: DataFrame, b: DataFrame, a_key: str, b_key: str, probe: str = "probe_id", frame: str = "frame", signed: DataFrame | None = None) -> DataFrame:
    """A3: (a_key, b_key, n) of candidates that select the same frames on every probe, told by signature and then verified frame by frame.

    Candidates that select nothing anywhere are not compared. ``signed``: the signatures of ``a``, where they are there already.
    """
    sa, sb = signatures(a, a_key, probe, frame) if signed is None else signed, signatures(b, b_key, probe, frame)
    pairs = sa.join(sb.drop("n"), "signature").select(a_key, b_key, "n")
    met = a.join(pairs, a_key).join(b.select(b_key, probe, frame), [b_key, probe, frame])
    return met.groupBy(a_key, b_key).agg(F.first("n").alias("n"), F.count("*").alias("_met")).where("n = _met").drop("_met")


def set_hash(df: DataFrame, group: Sequence[str], *elements: str) -> DataFrame:
    """The digest of a group's elements, in order, as canonical JSON; the same whatever the order of rows.

    The digest is of the whole set as one text, so a group's elements pass through one task in
    order; they are sorted by Spark, which spills, and hashed as they pass, so that no set
    is held in memory.
    """
    item = F.struct(*[F.col(e).alias(e) for e in sorted(elements)])
    kinds = ", ".join(f"`{g}` {df.schema[g].dataType.simpleString()}" for g in group)
    rows = df.select(*group, item.alias("_item")).repartition(*group).sortWithinPartitions(*group, "_item").select(*group, F.to_json("_item", {"ignoreNullFields": "false"}).alias("_json"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, hashed, n = None, None, 0

        def ended() -> pa.RecordBatch:
            hashed.update(b"]")
            return pa.RecordBatch.from_arrays([*key.columns, pa.array([hashed.hexdigest()]), pa.array([n], pa.int64())], [*group, "set_hash", "n"])

        for batch in batches:
            keys, texts = batch.select(list(group)), batch.column("_json").to_pylist()
            told = keys.to_pylist()
            at = 0
            while at < len(texts):
                to = at + 1
                while to < len(texts) and told[to] == told[at]:
                    to += 1
                if key is None or key.to_pylist()[0] != told[at]:
                    if key is not None:
                        yield ended()
                    key, hashed, n = keys.slice(at, 1), hashlib.sha256(b"["), 0
                hashed.update((("," if n else "") + ",".join(texts[at:to])).encode())
                n += to - at
                at = to
        if key is not None:
            yield ended()

    return rows.mapInArrow(digest, f"{kinds}, set_hash string, n long")


def prefix_verdicts(frames: DataFrame, label: Column, hit: Column, boundary: Column, case: Sequence[str] = (), probe: str = "probe_id", frame: str = "frame") -> DataFrame:
    """The verdict on frames up to a boundary next to that on all, and the later frames that turn it.

    v1: 'unscorable' if no probe expects a frame up to the boundary. One scan; only counts are shuffled.
    """
    early = F.col(frame) <= boundary
    wrong = label != hit
    per = frames.groupBy(*case, probe).agg(
        F.count_if(label & early).alias("e1"), F.count_if(wrong & early).alias("w1"), F.count_if(label).alias("e2"), F.count_if(wrong).alias("w2"),
        F.count_if(wrong & ~early).alias("turning"),
    )
    return per.groupBy(*case).agg(
        F.when(F.sum("e1") == 0, "unscorable").when(F.sum("w1") == 0, "strong_exact").otherwise("silent_wrong").alias("v1"),
        F.when((F.sum("w2") == 0) & (F.sum("e2") > 0), "strong_exact").otherwise("silent_wrong").alias("v2"),
        F.sum("turning").alias("turning_frames"),
    )


def leaf_matches(frames: DataFrame, tree: Tree, catalog: Mapping[str, Field], where: Column, keys: Sequence[str] = ("probe_id", "frame")) -> DataFrame:
    """A row (keys, path, leaf, matched) per leaf, for the frames of ``where`` alone (the counterexamples).

    Equal leaves are computed once: they are columns of one projection.
    """
    rows = [
        F.struct(F.lit(".".join(map(str, path)) or "root").alias("path"), F.lit(f"{x.field} {x.op}").alias("leaf"), columns.column(x, catalog).alias("matched"))
        for path, x in leaves(tree)
    ]
    return frames.where(where).select(*keys, F.inline(F.array(*rows)))


def recomposed(tree: Tree, matched: Mapping[str, Column], path: tuple[int, ...] = ()) -> Column:
    """The tree over leaf columns by path: must equal the root's own column on every frame."""
    if isinstance(tree, Leaf):
        return matched[".".join(map(str, path)) or "root"]
    parts = [recomposed(p, matched, (*path, i)) for i, p in enumerate(children(tree))]
    if isinstance(tree, Neither):
        return ~parts[0]
    return functools.reduce(lambda a, b: a & b if isinstance(tree, Both) else a | b, parts)


def within_budget(paths: Column, calls: Column, frames: Column) -> Column:
    """Whether a trace stays in its limits."""
    return (paths <= TRACE_PATHS) & (calls <= TRACE_CALLS) & (frames <= TRACE_FRAMES) & (paths * frames <= TRACE_CELLS)


def replay(recorded: DataFrame, replayed: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Rows that are on one side only or differ; equal tables give none."""
    a, b = recorded.select(*keys, *[F.col(v).alias(f"recorded_{v}") for v in values], F.lit(True).alias("_a")), replayed.select(
        *keys, *[F.col(v).alias(f"replayed_{v}") for v in values], F.lit(True).alias("_b")
    )
    differs = functools.reduce(lambda x, y: x | y, [~F.col(f"recorded_{v}").eqNullSafe(F.col(f"replayed_{v}")) for v in values], F.lit(False))
    status = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "added").when(differs, "changed")
    return a.join(b, list(keys), "full").withColumn("status", status).where("status is not null").drop("_a", "_b")


def first_error(codes: Column, owned: Sequence[str]) -> Column:
    """The first code that the candidate owns; codes of the harness charge nobody."""
    return F.element_at(F.filter(codes, lambda c: c.isin(*owned)), 1)


def status_match(status: Column, gold: Column) -> Column:
    """E9."""
    return status.eqNullSafe(gold)


def slot_match(missing: Column, gold: Column) -> Column:
    """Whether some missing slot is one that gold misses; null slots match nothing."""
    return F.coalesce(F.arrays_overlap(missing, gold), F.lit(False))


def field_coverage(gold: Column, shown: Column) -> list[Column]:
    """Distinct gold fields, distinct shown fields, and how many are both."""
    g, s = F.array_distinct(gold), F.array_distinct(shown)
    return [F.size(g).alias("gold_fields"), F.size(s).alias("shown_fields"), F.size(F.array_intersect(g, s)).alias("shown_gold_fields")]
