"""Operator 3: a store of immutable shards with size-tiered compaction.

``append`` writes what arrives as small Parquet shards. ``compact`` looks at the
sizes of runs (the shards of one append or merge): whenever ``FANOUT`` runs lie in
one size tier, they are read once and written as one run of files of about
``TARGET`` bytes. Shards are never changed; every append or merge commits a new
version of the manifest, the list of live shards.

A commit is one rename that fails if the version exists, so two writers can't
both make it: the loser reads the winner's manifest and tries again. That holds
where the file system's rename is atomic and doesn't replace (HDFS); on local disks
and object stores Hadoop looks first and renames then, so one writer at a time must
be seen to from outside. A merge whose inputs are gone by then gives up. Readers take the newest version and see
either all of a commit or nothing of it. ``vacuum`` deletes manifests that are no longer
kept and the shards that only they name. Shards that no manifest names may be those
of a writer about to commit: they are swept only once they are ``GRACE`` seconds old,
so a writer must commit within that time of writing. A merge whose inputs are deleted
while it reads them gives up like one that was forestalled.

A merge's task writes a file of ``TARGET`` compressed bytes at most, and reads as much
(text takes some two to four times that as rows); that bound is the files', not the table's.

Only file names, sizes and counts pass through the driver. Work lost with an
executor is Spark's to repeat: files count once the write has been committed.

Edge cases: an empty arrival commits a version without shards; rows are kept as
they are (nulls, repeats, any columns); arrivals must have the store's columns, in
any order, whatever their names; reading an empty store needs a schema.
"""

from __future__ import annotations

import json
import math
import re
import time
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TARGET, SMALLEST, FANOUT, RETRIES = 64 << 20, 1 << 20, 4, 20
#: Age in seconds from which shards that no manifest names count as left behind.
GRACE = 7 * 24 * 3600


@dataclass(frozen=True)
class Shard:
    path: str
    bytes: int


@dataclass(frozen=True)
class Run:
    name: str
    level: int
    shards: tuple[Shard, ...]

    @property
    def bytes(self) -> int:
        return sum(s.bytes for s in self.shards)


@dataclass(frozen=True)
class Manifest:
    version: int = 0
    schema: str | None = None
    runs: tuple[Run, ...] = field(default=())


class Conflict(Exception):
    """The runs that a merge has read are no longer live."""


class Busy(Exception):
    """Other writers committed first, time after time."""


def tier(size: int, smallest: int = SMALLEST, fanout: int = FANOUT) -> int:
    """0 up to ``smallest`` bytes, then one more for every factor ``fanout``."""
    return 0 if size <= smallest else 1 + int(math.log(size / smallest, fanout))


class Store:
    """A table of shards below ``path``, a URI in a file system that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str, target: int = TARGET, smallest: int = SMALLEST, fanout: int = FANOUT):
        self.spark, self.path = spark, path.rstrip("/")
        self.target, self.smallest, self.fanout = target, smallest, fanout
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path("manifests"))

    def _path(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}" if name else self.path)

    def _list(self, name: str) -> list:
        return list(self._fs.listStatus(self._path(name))) if self._fs.exists(self._path(name)) else []

    def manifest(self, version: int | None = None) -> Manifest:
        """The newest version, or the one asked for."""
        versions = [int(s.getPath().getName()[:-5]) for s in self._list("manifests") if s.getPath().getName().endswith(".json") and s.getPath().getName()[0] != "_"]
        newest, version = version is None, max(versions, default=0) if version is None else version
        if not version:
            return Manifest()
        try:
            stream = self._fs.open(self._path(f"manifests/{version:012d}.json"))
        except Exception as e:
            if newest and "FileNotFound" in str(e):  # a newer one came and this one went meanwhile
                return self.manifest()
            raise
        try:
            raw = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        x = json.loads(raw)
        return Manifest(x["version"], x["schema"], tuple(Run(r["name"], r["level"], tuple(Shard(**s) for s in r["shards"])) for r in x["runs"]))

    def _commit(self, change) -> Manifest:
        """Applies ``change`` to the newest manifest and publishes the result as the next version."""
        context = self._hadoop.FileContext.getFileContext(self._path("").toUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark._jvm.java.lang.reflect.Array.newInstance(self._hadoop.Options.Rename.NONE.getClass(), 1)
        options[0] = self._hadoop.Options.Rename.NONE  # fails if the version is there
        for _ in range(RETRIES):
            new = change(self.manifest())
            name = f"{new.version:012d}.json"
            staged = self._path(f"manifests/_{uuid.uuid4().hex}")
            out = self._fs.create(staged, False)
            out.write(bytearray(json.dumps(asdict(new)).encode()))
            out.close()
            try:
                context.rename(staged, self._path(f"manifests/{name}"), options)
                return new
            except Exception as e:
                self._fs.delete(staged, False)
                if "FileAlreadyExists" not in str(e):
                    raise
        raise Busy(f"no commit in {RETRIES} tries")

    def _write(self, df: DataFrame, level: int) -> Run:
        name = uuid.uuid4().hex
        df.write.parquet(f"{self.path}/data/{name}")
        return self._run(name, level)

    def _run(self, name: str, level: int) -> Run:
        """The run of the shards that were written to this folder."""
        shards = [Shard(f"data/{name}/{s.getPath().getName()}", s.getLen()) for s in self._list(f"data/{name}") if s.getPath().getName().startswith("part-")]
        return Run(name, level, tuple(sorted(shards, key=lambda s: s.path)))

    def append(self, df: DataFrame) -> Manifest:
        """Adds the rows of ``df`` as new shards."""
        return self._add(self._write(df, 0), df.schema.json())

    def append_parts(self, df: DataFrame, part: Column) -> Iterator[Manifest]:
        """Adds the rows of ``df`` as one run for each value of ``part`` (numbers), in order, or a version without shards; ``df`` is read once."""
        name, staged = "_part", f"staged/{uuid.uuid4().hex}"
        while name.lower() in {c.lower() for c in df.columns}:
            name += "_"
        df.withColumn(name, part).write.partitionBy(name).parquet(f"{self.path}/{staged}")
        folders = [s.getPath().getName() for s in self._list(staged) if s.getPath().getName().startswith(f"{name}=")]
        self._fs.mkdirs(self._path("data"))
        if not folders:
            yield self._add(Run(uuid.uuid4().hex, 0, ()), df.schema.json())
        for folder in sorted(folders, key=lambda f: int(f.partition("=")[2])):
            run = uuid.uuid4().hex
            self._fs.setTimes(self._path(f"{staged}/{folder}"), int(time.time() * 1000), -1)  # it may have waited long for its turn
            if not self._fs.rename(self._path(f"{staged}/{folder}"), self._path(f"data/{run}")):
                raise OSError(f"{staged}/{folder} can't be moved")
            yield self._add(self._run(run, 0), df.schema.json())
        self._fs.delete(self._path(staged), True)

    def _add(self, run: Run, schema: str) -> Manifest:
        def change(m: Manifest) -> Manifest:
            if m.schema and {(f["name"], str(f["type"])) for f in json.loads(m.schema)["fields"]} != {(f["name"], str(f["type"])) for f in json.loads(schema)["fields"]}:
                raise ValueError("the arrival's columns are not the store's")
            return Manifest(m.version + 1, m.schema or schema, (*m.runs, run) if run.shards else m.runs)

        return self._commit(change)

    def due(self, m: Manifest) -> list[Run]:
        """The runs that a merge should take next: those of the smallest full tier."""
        tiers: dict[int, list[Run]] = {}
        for r in m.runs:
            tiers.setdefault(tier(r.bytes, self.smallest, self.fanout), []).append(r)
        full = [runs for _, runs in sorted(tiers.items()) if len(runs) >= self.fanout]
        return full[0] if full else []

    def compact(self) -> Manifest:
        """Merges until no tier is full; gives up after ``RETRIES`` merges that other writers forestalled."""
        lost = 0
        while runs := self.due(m := self.manifest()):
            files = max(1, -(-sum(r.bytes for r in runs) // self.target))
            gone = {r.name for r in runs}
            try:
                merged = self._write(self._frame(m, runs).repartition(files), 1 + max(r.level for r in runs))
            except Exception:
                if gone <= {r.name for r in self.manifest().runs}:
                    raise
                lost += 1  # merged and deleted by another writer while they were read
                if lost >= RETRIES:
                    raise
                continue

            def change(now: Manifest, gone=gone, merged=merged) -> Manifest:
                if not gone <= {r.name for r in now.runs}:
                    raise Conflict("the runs were merged by another writer")
                return Manifest(now.version + 1, now.schema, (*[r for r in now.runs if r.name not in gone], merged))

            try:
                self._commit(change)
            except Conflict:
                self._fs.delete(self._path(f"data/{merged.name}"), True)
                lost += 1
                if lost >= RETRIES:
                    raise Busy(f"{lost} merges were forestalled") from None
        return m

    def vacuum(self, keep_versions: int = 1, grace: float = GRACE) -> None:
        """Deletes older manifests and the shards that only they name, and shards of no manifest that are ``grace`` seconds old; other writers may be at work."""
        old = time.time() * 1000 - 1000 * grace
        waiting = [s for kind in ("data", "staged") for s in self._list(kind) if s.getModificationTime() < old]  # before the manifests are read
        versions = sorted(int(s.getPath().getName()[:-5]) for s in self._list("manifests") if re.fullmatch(r"\d+\.json", s.getPath().getName()))
        split = max(0, len(versions) - keep_versions)
        kept = [self.manifest(v) for v in versions[split:]]
        live = {r.name for m in kept for r in m.runs}
        for v in versions[:split]:
            try:
                ended = self.manifest(v)
            except Exception as e:  # another vacuum was first
                if "FileNotFound" in str(e):
                    continue
                raise
            for r in ended.runs:
                if r.name not in live:
                    self._fs.delete(self._path(f"data/{r.name}"), True)
            self._fs.delete(self._path(f"manifests/{v:012d}.json"), False)
        for s in waiting:
            if s.getPath().getName() not in live:
                self._fs.delete(s.getPath(), True)

    def _frame(self, m: Manifest, runs) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(m.schema))
        paths = [f"{self.path}/{s.path}" for r in runs for s in r.shards]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version."""
        m = self.manifest(version)
        if not m.schema:
            raise ValueError("the store is empty and has no schema")
        return self._frame(m, m.runs)


def arrive(df: DataFrame, store: Store, batches: int = 8) -> Manifest:
    """Appends ``df`` in ``batches`` arrivals (by a hash of doc_id), compacting after each; one scan writes them all."""
    for _ in store.append_parts(df, F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int")):
        store.compact()
        store.vacuum()
    return store.manifest()
