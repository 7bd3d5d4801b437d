"""A ledger of executions that can be taken up again.

A batch is what one candidate selects on one probe. A run writes the rows of the
batches that it was asked for and then, in a second write, an entry for each with the
digest of its rows: batches without an entry don't count. Whoever takes the ledger up
reads the rows that are there, makes their digests anew and keeps the batches whose
digest still holds; only the others are executed again. Digests are sums and
exclusive ors of row hashes, so batches of any size are checked by partial aggregates.

Edge cases: a batch that selects nothing has an entry with no rows; of several entries
for a batch the newest that holds is kept; rows that appear twice spoil their batch.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packsieve.operators import matching
from packsieve.operators.predicates import Field, Tree

ENTRY = "candidate string, probe_id string, run string, turn long, n long, digest string"


def digested(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n, digest) of the rows (candidate, probe_id, frame and other keys)."""
    h = F.xxhash64("candidate", "probe_id", "frame")
    per = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(h.cast("decimal(20,0)")).alias("_sum"), F.bit_xor(h).alias("_xor"))
    return per.select(*keys, "n", F.sha2(F.concat_ws("/", F.col("n").cast("string"), F.col("_sum").cast("string"), F.col("_xor").cast("string")), 256).alias("digest"))


class Ledger:
    """Executions below ``path``, a URI that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str, frame_type: str = "long"):
        self.spark, self.path = spark, path.rstrip("/")
        self._rows = f"candidate string, probe_id string, frame {frame_type}, run string"

    def _read(self, kind: str, schema: str) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path.toString())

    def rows(self) -> DataFrame:
        """(candidate, probe_id, frame, run) of all runs, whether their batches hold or not."""
        return self._read("rows", self._rows)

    def entries(self) -> DataFrame:
        return self._read("entries", ENTRY)

    def valid(self) -> DataFrame:
        """(candidate, probe_id, run, n): of each batch the newest entry whose digest is that of its rows."""
        keys = ["candidate", "probe_id", "run"]
        found = digested(self.rows(), keys).withColumnsRenamed({"n": "_n", "digest": "_digest"})
        holds = self.entries().join(found, keys, "left").where((F.col("n") == F.coalesce("_n", F.lit(0))) & ((F.col("n") == 0) | (F.col("digest") == F.col("_digest"))))
        newest = Window.partitionBy("candidate", "probe_id").orderBy(F.desc("turn"), "run")
        return holds.withColumn("_r", F.row_number().over(newest)).where("_r = 1").select(*keys, "n")

    def matches(self) -> DataFrame:
        """(candidate, probe_id, frame) of the batches that hold."""
        return self.rows().join(self.valid().select("candidate", "probe_id", "run"), ["candidate", "probe_id", "run"]).select("candidate", "probe_id", "frame")

    def spoil(self, candidate: str, probe: str) -> None:
        """Adds a row again to what a batch holds, as a write that was repeated would: for tests and drills."""
        one = self.rows().where((F.col("candidate") == candidate) & (F.col("probe_id") == probe)).limit(1)
        for r in one.select("run").collect():
            one.drop("run").write.mode("append").parquet(f"{self.path}/rows/run={r.run}")

    def open(self, candidates: Sequence[str], probes: DataFrame) -> DataFrame:
        """(candidate, probe_id) of the batches that are still to be executed."""
        plan = probes.select("probe_id").distinct().withColumn("candidate", F.explode(F.array(*map(F.lit, candidates)).cast("array<string>")))
        return plan.select("candidate", "probe_id").join(self.valid(), ["candidate", "probe_id"], "left_anti")

    def execute(self, frames: DataFrame, trees: Mapping[str, Tree], catalog: Mapping[str, Field], probes: DataFrame, only: DataFrame | None = None) -> list[tuple[str, str]]:
        """Executes the batches that are open (of ``only``: candidate, probe_id) and returns them; a batch is a pair of names, so their list is the plan's size."""
        todo = self.open(list(trees), probes)
        todo = [(r.candidate, r.probe_id) for r in (todo if only is None else todo.join(only, ["candidate", "probe_id"])).collect()]
        if not todo:
            return []
        run, turn = uuid.uuid4().hex, 1 + (self.entries().agg(F.max("turn")).first()[0] or 0)
        asked = F.broadcast(self.spark.createDataFrame(todo, "candidate string, probe_id string"))
        wanted = {c: trees[c] for c in dict.fromkeys(c for c, _ in todo)}
        there = frames.where(F.col("probe_id").isin(*{p for _, p in todo}))
        made = matching.matches(there, wanted, catalog).join(asked, ["candidate", "probe_id"]).select("candidate", "probe_id", "frame")
        made.write.parquet(f"{self.path}/rows/run={run}")
        found = digested(self.spark.read.parquet(f"{self.path}/rows/run={run}"), ["candidate", "probe_id"])
        entries = asked.join(found, ["candidate", "probe_id"], "left").select("candidate", "probe_id", F.lit(turn).cast("long").alias("turn"), F.coalesce("n", F.lit(0)).alias("n"), "digest")
        entries.write.parquet(f"{self.path}/entries/run={run}")
        return todo
