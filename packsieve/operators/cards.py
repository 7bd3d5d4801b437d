"""Counterexample cards: the few frames that show how a candidate is wrong."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Frames and bytes of a card, and the ports that count as one when repeats are told.
FRAMES, BYTES, EPHEMERAL = 3, 1024, (41000, 51254)


def same_port(port: Column) -> Column:
    """Ephemeral ports are one value to the repeat check."""
    return F.when(port.between(*EPHEMERAL), F.lit(EPHEMERAL[0])).otherwise(port)


def chosen(wrong: DataFrame, group: Sequence[str], facts: Sequence[str], frame: str = "frame", most: int = FRAMES, ports: Sequence[str] = ()) -> DataFrame:
    """Of a group's disagreeing frames (column ``side``: 'missed' or 'wrong'), those its card shows, with ``position`` from 1.

    Sides alternate in frame order, starting with missed; frames with the facts
    of an earlier one are skipped; the first ``most`` stay. No task sorts a whole
    group: first frames are minima, and the turns of the few that are left are counts; a
    group with very many frames is split by the adaptive join that counts them.
    """
    key = F.struct(*group, "side").alias("_key")  # never null, so null groups meet like any other
    told = F.struct(*[(same_port(F.col(f)) if f in ports else F.col(f)).alias(f"_{f}") for f in facts]).alias("_told")
    rows = wrong.select("*", key, told)
    # of frames that tell the same the first, by partial minima; of those the first few of a side
    first = rows.groupBy("_key", "_told").agg(F.min_by(F.struct(*wrong.columns), F.col(frame)).alias("_row"), F.min(frame).alias("_at"))
    few = first.withColumn("_nth", F.row_number().over(Window.partitionBy("_key").orderBy("_at"))).where(F.col("_nth") <= most)
    # their turns: how many frames of the side, repeats included, come up to each
    at = few.groupBy("_key").agg(F.sort_array(F.collect_list("_at")).alias("_upto"))
    turns = rows.select("_key", F.col(frame).alias("_f")).join(at, "_key").groupBy("_key").agg(
        F.array(*[F.count_if(F.col("_f") <= F.get("_upto", F.lit(i))) for i in range(most)]).alias("_turns")
    )
    placed = few.join(turns, "_key").select("_row.*", F.element_at("_turns", F.col("_nth")).alias("_turn"))
    place = Window.partitionBy(*group).orderBy("_turn", "side")
    return placed.withColumn("position", F.row_number().over(place)).where(F.col("position") <= most).drop("_turn")


def fitting(rows: DataFrame, group: Sequence[str], card_json: Column, most: int = BYTES) -> DataFrame:
    """Frames kept from the front while the card's bytes fit: a running sum is monotone, so a prefix stays."""
    w = Window.partitionBy(*group).orderBy("position").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("card_bytes", F.sum(F.octet_length(card_json) + 1).over(w) + 1).where(F.col("card_bytes") <= most)


def kind(error_code: Column, frames: Column) -> Column:
    """What card an item gets: an error card, none (nothing to show), or frames."""
    return F.when(error_code.isNotNull(), "error").when(F.coalesce(frames, F.lit(0)) == 0, "none").otherwise("frames")
