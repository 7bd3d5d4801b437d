"""Runs, outcomes, attempts, training rows as JSON (S12, S13, S15, S18): explicit schemas, unreadable lines fail the read."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pandas as pd
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OUTCOME = (
    "condition string, item_id string, case_id string, outcome string, error_code string, http_status int, provider_error_code string, abstention_status string, finish_reason string, "
    "candidate_filter string, probe_exact array<boolean>, packet_set_hash string, gold_field_count int, retrieved_field_count int, retrieved_gold_field_count int, prompt_tokens bigint, "
    "completion_tokens bigint, latency_ms double, shortcuts array<struct<rule: string, token: string>>, disjunctions int, gold_status string, status_match boolean, slot_match boolean"
)
ATTEMPT = (
    "run string, condition string, item_id string, attempt int, status string, response_text string, error_code string, latency_ms double, http_status int, provider string, finish_reason string, "
    "prompt_tokens bigint, completion_tokens bigint, reasoning_tokens bigint, reasoning_present boolean, cost_usd double, charged_micro_usd bigint"
)
OBSERVATION = "probe_id string, candidate_frames array<int>"
TRAINING = "candidate bigint, request string, ir string, key string, filter string, frames array<int>"


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object per line, gzip or not."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def run_directory(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole-file JSON below run/condition/item.json, with the three names taken from the path."""
    parts = F.split(F.col("_metadata.file_path"), "/")
    at = lambda i: F.element_at(parts, F.lit(i))
    raw = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)
    return raw.select(at(-3).alias("run"), at(-2).alias("path_condition"), F.regexp_replace(at(-1), r"\.json$", "").alias("path_item"), "*")


#: Paths that a task hands on, and bytes of a file that it reads, at a time.
PATHS, CHUNK = 1000, 1 << 20


def _below(folders: DataFrame, name: str) -> DataFrame:
    """(path): the folders name=... right below these. Tasks list them, so no path passes through the driver; a task holds one folder's names."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for folder in batch.path:
                fs, place = pyarrow.fs.FileSystem.from_uri(folder[: folder.index("\t")])
                inner = folder[folder.index("\t") + 1 :]
                held = [f"{folder}/{i.base_name}" for i in fs.get_file_info(pyarrow.fs.FileSelector(place + inner)) if i.base_name.startswith(f"{name}=")]
                for k in range(0, len(held), PATHS):
                    yield pd.DataFrame({"path": held[k : k + PATHS]})

    return folders.mapInPandas(run, "path string").repartition("path")


def run_files(spark: SparkSession, path: str) -> DataFrame:
    """(run, condition, item, bytes, digest) of the files below run=/condition=/item=: names from the paths, SHA-256 of the bytes, whatever they hold."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for folder in batch.path:
                top, inner = folder.split("\t", 1)
                fs, place = pyarrow.fs.FileSystem.from_uri(top)
                names = [unquote(part.split("=", 1)[1]) for part in inner.split("/")[1:]]
                for info in fs.get_file_info(pyarrow.fs.FileSelector(place + inner, recursive=True)):
                    if info.is_file and info.base_name.startswith("part-"):
                        digest = hashlib.sha256()
                        with fs.open_input_stream(info.path, compression=None) as stream:
                            while held := stream.read(CHUNK):
                                digest.update(held)
                        rows.append((*names, info.size, digest.hexdigest()))
            yield pd.DataFrame(rows, columns=["run", "condition", "item", "bytes", "digest"])

    # the folder's URI and what lies below it, a tab between them: only the first is one
    folders = spark.range(1).select(F.lit(f"{path}\t").alias("path"))
    for name in ("run", "condition", "item"):
        folders = _below(folders, name)
    return folders.mapInPandas(read, "run string, condition string, item string, bytes long, digest string")


def write_run(rows: DataFrame, path: str) -> None:
    """A file for each (run, condition, item), below its names, with a line for each of its rows' value text. Tasks write them and tell how many, not where."""
    keys = ["run", "condition", "item"]

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, top = pyarrow.fs.FileSystem.from_uri(path)
        at = stream = None
        files = 0
        for batch in batches:
            for *key, value in batch.itertuples(index=False):
                if key != at:
                    if stream:
                        stream.close()
                    folder = "/".join([top, *(f"{k}={quote(v, safe=' ')}" for k, v in zip(keys, key, strict=True))])
                    fs.create_dir(folder, recursive=True)
                    at, stream, files = key, fs.open_output_stream(f"{folder}/part-0.txt", compression=None), files + 1
                stream.write(f"{value}\n".encode())
        if stream:
            stream.close()
        yield pd.DataFrame({"files": [files]})

    dealt = rows.select(*keys, "value").repartition(*keys).sortWithinPartitions(*keys, "value")
    dealt.mapInPandas(write, "files long").agg(F.sum("files")).first()


def observations(spark: SparkSession, path: str) -> DataFrame:
    """Recorded candidate frames as rows (probe_id, frame)."""
    return jsonl(spark, path, OBSERVATION).select("probe_id", F.explode("candidate_frames").alias("frame"))
