"""Prompts as columns, and checks that what was shown is what was recorded.

A prompt is one text per item: the fixed instructions, examples best last, the
retrieved fields as a JSON list, and the request as a JSON string, so that nothing
in a request can end its own section.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packsieve.functions import jsons


def quoted(x: Column) -> Column:
    """A text as a JSON string."""
    return F.regexp_extract(F.to_json(F.struct(x.alias("v")), {"ignoreNullFields": "false"}), r'^\{"v":(.*)\}$', 1)


def listed(rows: DataFrame, item: str, rank: str, columns: Sequence[str], name: str) -> DataFrame:
    """(item, name): an item's rows as a JSON list in rank order, keys sorted. Ranks are bounded by the retrieval's k."""
    body = F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), body.alias("b")))), lambda s: s["b"])
    return rows.groupBy(item).agg(F.concat(F.lit("["), F.array_join(ordered, ","), F.lit("]")).alias(name))


def assembled(items: DataFrame, instructions: str, item: str = "item_id", intent: str = "intent", context: DataFrame | None = None, shown: DataFrame | None = None) -> DataFrame:
    """(item, prompt, prompt_sha256). ``context`` and ``shown``: (item, context) and (item, examples) as ``listed`` makes them."""
    rows = items
    parts = [F.lit(instructions)]
    for table, name in ((shown, "examples"), (context, "context")):
        if table is not None:
            rows = rows.join(table.select(item, name), item, "left")
            parts.append(F.concat(F.lit(f'{{"{name}":'), F.coalesce(name, F.lit("[]")), F.lit("}")))
    parts.append(F.concat(F.lit('{"request":'), quoted(F.col(intent)), F.lit("}")))
    out = rows.select(item, F.concat_ws("\n", *parts).alias("prompt"))
    return out.withColumn("prompt_sha256", jsons.digest(F.col("prompt")))


def follow_up(prompt: Column, answer: Column, card: Column) -> Column:
    """The prompt of a repair round: the first one, the answer, and the card, each as it was."""
    return F.concat_ws("\n", prompt, F.concat(F.lit('{"answer":'), quoted(answer), F.lit("}")), F.when(card.isNotNull(), F.concat(F.lit('{"card":'), card, F.lit("}"))))


def not_rebuilt(recorded: DataFrame, rebuilt: DataFrame, item: str = "item_id") -> DataFrame:
    """Items whose recorded prompt digest is not the rebuilt one, or that one side lacks."""
    a, b = recorded.select(item, F.col("prompt_sha256").alias("_a")), rebuilt.select(item, F.col("prompt_sha256").alias("_b"))
    return a.join(b, item, "full").where(~F.col("_a").eqNullSafe(F.col("_b"))).select(item)


def not_as_shown(prompts: DataFrame, context: DataFrame, item: str = "item_id") -> DataFrame:
    """Items whose prompt does not hold the recorded context."""
    held = F.contains("prompt", F.concat(F.lit('{"context":'), F.coalesce("context", F.lit("[]")), F.lit("}")))
    return prompts.join(context, item, "left").where(~held).select(item)


def receipts(rows: DataFrame, keys: Sequence[str] = ("run_id", "condition", "item_id")) -> DataFrame:
    """One line per receipt: probes, exact ones, frames on one side only."""
    p = F.col("probes")
    only = lambda side: F.aggregate(p, F.lit(0), lambda a, x: a + F.size(x[side]))
    return rows.select(*keys, F.size(p).alias("probes"), F.size(F.filter(p, lambda x: x["exact"])).alias("exact"), only("reference_only").alias("reference_only"), only("candidate_only").alias("candidate_only"))
