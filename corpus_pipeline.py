"""From raw documents to packed training sequences, in five stages.

Every stage reads what the one before it has written, works on all of it, and
all but the last return the columns of ``documents``.

Edge cases: rows without text, or without a letter in it, go in the first stage; rows
that repeat a doc_id are rows of their own, and those that repeat the text too are told
once from the second stage on; further columns, whatever their names, pass through all
stages but the last; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from packsieve.llm import exact_dedup, language_id, mixing, packing, scratch, simhash


def tell_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents whose language can't be told go."""
    return language_id.keep(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: of equal texts the smallest doc_id stays."""
    return exact_dedup.drop(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: of texts that share 0.8 of their five-word shingles, or whose fingerprints are 4 bits apart, the smallest doc_id stays."""
    return simhash.drop(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: words taken and repeated until sources have their target weights."""
    return mixing.apply(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: pieces of token ids, with their place in a sequence."""
    return packing.pack(docs)


STAGES = [
    ("language", tell_language),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The stages hold learned models, hashes and tokenizers that SQL does not have; tests compare them with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.table(docs, name)
    return docs
