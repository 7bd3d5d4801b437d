"""Connected components of a table of links, as rounds of joins and minima.

Every round a node takes the smallest label among its own and its neighbours',
then the label of its label. Minima are taken with partial aggregates, so a node
with very many links costs its partition no more than others. Each round is a
written table; the only thing that the driver sees is how many labels changed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packsieve.llm import scratch


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable. ``links`` has a and b long, either way round, repeats allowed."""
    both = scratch.table(
        links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct(), "links"
    )
    labels = scratch.table(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        heard = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("_heard"))
        nearer = scratch.table(
            labels.join(heard, "node").select("node", F.col("component").alias("_old"), F.least("component", "_heard").alias("_new")), "nearer"
        )
        jump = nearer.select(F.col("node").alias("_new"), F.col("_new").alias("component"))
        after = scratch.table(nearer.join(jump, "_new").select("node", "_old", F.least("_new", "component").alias("component")), "labels")
        changed = after.where("component != _old").limit(1).count()
        scratch.drop(labels)
        scratch.drop(nearer)
        labels = after.select("node", "component")
        labels.scratch_path = after.scratch_path
        if not changed:
            scratch.drop(both)
            return labels
