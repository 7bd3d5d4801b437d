"""The mutation-adequacy gate: what becomes of every mutant, and the counters that must be zero.

A case has labels, its filters and the mutants of its gold. Some probes are scored;
the feedback probes decide nothing, but tell whether a mutant could be seen there.
All filters of all cases run in one scan of the frames, fifty to a projection; what
comes out of it are two numbers for each filter: whether it differs from its labels on
a scored probe and on a feedback probe.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packsieve.operators import columns, filter_text, matching
from packsieve.operators.mutants import Mutant
from packsieve.operators.predicates import Field, Refused, Tree, leaves

#: What becomes of a mutant, from the least to the most that was found out about it.
STATUSES = ("uncompilable", "rejected", "killed", "survived")
# The counters of the gate.
COUNTERS = (
    "label_mismatches", "canonical_mismatches", "mutation_label_mismatches", "undistinguished_mutations", "unwaived_survivors", "stale_waivers",
    "feedback_undistinguished_mutations", "feedback_blind_mutants", "disproved_waivers",
)
ROW = "case_id string, role string, category string, edit string, filter string, state string"


@dataclass(frozen=True)
class Case:
    """Labels of the gold and of its deliberate mutation, as conditions on a frame; its filters; the mutants of its gold."""

    case_id: str
    label: Column
    reference: Tree
    canonical: Tree
    mutation: Tree
    mutation_label: Column
    mutants: tuple[Mutant, ...] = ()


def runnable(tree: Tree, catalog: Mapping[str, Field], held: Sequence[str]) -> bool:
    """Whether the frames have a column for each field of the tree."""
    return all(catalog[x.field].column in held for _, x in leaves(tree))


def prepared(cases: Sequence[Case], catalog: Mapping[str, Field], held: Sequence[str]) -> tuple[list[tuple], dict[tuple[str, str], Tree]]:
    """(rows, trees): a row as ``ROW`` for each filter, and the trees that run, by (case, filter). Equal texts of a case run once."""
    rows, trees = [], {}
    for case in cases:
        for role, tree in (("reference", case.reference), ("canonical", case.canonical), ("mutation", case.mutation)):
            text = filter_text.text(tree, catalog)
            trees[case.case_id, text] = tree
            rows.append((case.case_id, role, None, None, text, "runs"))
        seen = {filter_text.text(case.canonical, catalog)}
        for m in case.mutants:
            try:
                text = filter_text.text(m.tree, catalog)
            except Refused:
                rows.append((case.case_id, "mutant", m.category, m.edit, None, "uncompilable"))
                continue
            state = "duplicate" if text in seen else "runs" if runnable(m.tree, catalog, held) else "rejected"
            seen.add(text)
            if state == "runs":
                trees[case.case_id, text] = m.tree
            rows.append((case.case_id, "mutant", m.category, m.edit, text, state))
    return rows, trees


def measured(frames: DataFrame, cases: Sequence[Case], trees: Mapping[tuple[str, str], Tree], catalog: Mapping[str, Field], feedback: Column, probe: str = "probe_id") -> DataFrame:
    """(case_id, filter, labels, scored, seen, apart): by each kind of labels, whether the filter differs on a scored and on a feedback probe, and on how many probes."""
    label = {c.case_id: (c.label, c.mutation_label) for c in cases}
    asked = [(case, text, kind) for case, text in trees for kind in (0, 1)]

    def one(batch: Sequence[tuple]) -> DataFrame:
        differs = [label[case][kind] != columns.column(trees[case, text], catalog) for case, text, kind in batch]
        wide = frames.groupBy(probe, feedback.alias("_feedback")).agg(*[F.bool_or(d).alias(f"d{i}") for i, d in enumerate(differs)])
        names = F.array(*[F.struct(F.lit(case).alias("case_id"), F.lit(text).alias("filter"), F.lit(("gold", "mutation")[kind]).alias("labels"), F.col(f"d{i}").alias("differs")) for i, (case, text, kind) in enumerate(batch)])
        return wide.select("_feedback", F.inline(names))

    per_probe = matching.union([one(b) for b in matching.batches(asked)])
    return per_probe.groupBy("case_id", "filter", "labels").agg(
        F.bool_or(F.col("differs") & ~F.col("_feedback")).alias("scored"), F.bool_or(F.col("differs") & F.col("_feedback")).alias("seen"), F.count_if("differs").alias("apart")
    )


def statuses(spark: SparkSession, rows: Sequence[tuple], found: DataFrame, waivers: DataFrame) -> DataFrame:
    """A row for each mutant but duplicates: case_id, category, edit, filter, status, seen, blind, waived, disproved.

    ``waivers``: case_id, edit. A killed mutant that the feedback probes don't show is blind to
    them; a waiver of a survivor that they do show is disproved.
    """
    mutants = spark.createDataFrame([r for r in rows if r[1] == "mutant"], ROW).where("state <> 'duplicate'")
    gold = found.where("labels = 'gold'").select("case_id", "filter", "scored", "seen")
    met = mutants.join(gold, ["case_id", "filter"], "left").join(waivers.select("case_id", "edit", F.lit(True).alias("_w")).distinct(), ["case_id", "edit"], "left")
    status = F.when(F.col("state") != "runs", F.col("state")).when(F.col("scored"), "killed").otherwise("survived")
    waived = (status == "survived") & F.coalesce("_w", F.lit(False))
    seen = F.coalesce("seen", F.lit(False))
    return met.select("case_id", "category", "edit", "filter", status.alias("status"), seen.alias("seen"), ((status == "killed") & ~seen).alias("blind"), waived.alias("waived"), (waived & seen).alias("disproved"))


def counters(spark: SparkSession, rows: Sequence[tuple], found: DataFrame, mutants: DataFrame, waivers: DataFrame) -> DataFrame:
    """(counter, n): the nine counters of the gate, zeros too. Mismatches are counted by probe."""
    roles = spark.createDataFrame([r for r in rows if r[1] != "mutant"], ROW).select("case_id", "role", "filter").join(found, ["case_id", "filter"])
    role = lambda name, labels: (F.col("role") == name) & (F.col("labels") == labels)
    mutation = role("mutation", "gold")
    by_role = roles.agg(
        F.sum(F.when(role("reference", "gold"), F.col("apart"))).alias(COUNTERS[0]), F.sum(F.when(role("canonical", "gold"), F.col("apart"))).alias(COUNTERS[1]), F.sum(F.when(role("mutation", "mutation"), F.col("apart"))).alias(COUNTERS[2]),
        F.count_if(mutation & ~F.col("scored")).alias(COUNTERS[3]), F.count_if(mutation & ~F.col("seen")).alias(COUNTERS[6]),
    )
    survivors = mutants.where("status = 'survived'")
    by_mutant = mutants.agg(F.count_if((F.col("status") == "survived") & ~F.col("waived")).alias(COUNTERS[4]), F.count_if("blind").alias(COUNTERS[7]), F.count_if("disproved").alias(COUNTERS[8]))
    stale = waivers.select("case_id", "edit").distinct().join(survivors.select("case_id", "edit"), ["case_id", "edit"], "left_anti").agg(F.count("*").alias(COUNTERS[5]))
    cells = lambda df: df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("counter"), F.coalesce(F.col(c), F.lit(0)).cast("long").alias("n")) for c in df.columns])))
    return cells(by_role).unionByName(cells(by_mutant)).unionByName(cells(stale))


def suite(spark: SparkSession, rows: Sequence[tuple], found: DataFrame) -> DataFrame:
    """Per case whether the reference agrees with the labels on every probe, whether the canonical filter agrees with the reference's labels too, and whether a scored probe tells the mutation."""
    roles = spark.createDataFrame([r for r in rows if r[1] != "mutant"], ROW).select("case_id", "role", "filter").join(found.where("labels = 'gold'"), ["case_id", "filter"])
    of = lambda role, test: F.bool_or(F.when(F.col("role") == role, test))
    return roles.groupBy("case_id").agg(of("reference", F.col("apart") == 0).alias("oracle_agrees"), of("canonical", F.col("apart") == 0).alias("candidate_agrees"), of("mutation", F.col("scored")).alias("mutation_told"))
