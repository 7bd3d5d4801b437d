"""Operator 10: token ids in independently compressed frames with a seek table.

A file holds documents in ascending doc_id order. Frames of about ``FRAME_IDS``
ids are zstandard frames of their own; after them come two skippable frames:
the index of documents (doc_id, frame, first id in the frame, number of ids) and
the seek table of the public zstd seekable format, with a checksum (low half of
XXH64) for each frame. A reader takes the last nine bytes, the seek table, the
index, and decompresses only the frames that hold the documents it wants.

Writing: rows are range-partitioned by doc_id and, for rows that repeat one, by a hash
of the row, sorted inside the partition, and every task writes one file under a name of its own
into the shared folder. The manifest, a written table, names the files of the
tasks that succeeded, so files of lost or repeated tasks are never read. Reading
deals the files over tasks of about ``READ_BYTES``.

Edge cases: a null text counts as empty; an empty text is the end id alone; null
doc_ids come first; rows that repeat a doc_id follow each other; an empty table
writes no file.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packsieve.llm import scratch, tokens

END_ID, VOCABULARY, FRAME_IDS = 2, "word_bpe_49k.json", 64 * 1024
#: Bytes of files that a reading task takes on average.
READ_BYTES = 8 << 20
SKIPPABLE, SEEK_MAGIC, INDEX_MAGIC = 0x184D2A5E, 0x8F92EAB1, 0x184D2A5D
ENTRY = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("frame", "<u4"), ("first", "<u8"), ("n", "<u8")])
SEEK = np.dtype([("compressed", "<u4"), ("plain", "<u4"), ("checksum", "<u4")])


def checksum(data: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(data) & 0xFFFFFFFF


class Writer:
    """Appends documents to an open binary stream."""

    def __init__(self, stream, frame_ids: int = FRAME_IDS):
        import zstandard

        self.stream, self.frame_ids = stream, frame_ids
        self.codec = zstandard.ZstdCompressor(level=3)
        self.part, self.size, self.seek, self.index = [], 0, [], []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.index.append((doc_id or 0, doc_id is None, len(self.seek), self.size // 4, len(ids) // 4))
        self.part.append(ids)
        self.size += len(ids)
        if self.size >= 4 * self.frame_ids:
            self.flush()

    def flush(self) -> None:
        if not self.part:
            return
        plain = b"".join(self.part)
        packed = self.codec.compress(plain)
        self.stream.write(packed)
        self.seek.append((len(packed), len(plain), checksum(plain)))
        self.part, self.size = [], 0

    def close(self) -> None:
        self.flush()
        index = self.codec.compress(np.array(self.index, dtype=ENTRY).tobytes())
        self.stream.write(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
        table = np.array(self.seek, dtype=SEEK).tobytes()
        foot = struct.pack("<IBI", len(self.seek), 0x80, SEEK_MAGIC)
        # the index is known by its place: its length stands before the seek table's frame
        self.stream.write(struct.pack("<II", SKIPPABLE, len(table) + len(foot)) + table + foot)


class Reader:
    """Random access to a file's documents; ``source`` is an open seekable binary file of ``size`` bytes."""

    def __init__(self, source, size: int):
        import zstandard

        self.source, self.codec = source, zstandard.ZstdDecompressor()
        frames, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEK_MAGIC or flags != 0x80:
            raise ValueError("no seek table")
        begin = size - 9 - frames * SEEK.itemsize
        self.seek = np.frombuffer(self._at(begin, frames * SEEK.itemsize), dtype=SEEK)
        self.begin = np.concatenate([[0], np.cumsum(self.seek["compressed"], dtype=np.int64)])
        at = int(self.begin[-1])
        _, length = struct.unpack("<II", self._at(at, 8))
        self.index = np.frombuffer(self.codec.decompress(self._at(at + 8, length)), dtype=ENTRY)

    def _at(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def frame(self, k: int) -> bytes:
        plain = self.codec.decompress(self._at(int(self.begin[k]), int(self.seek["compressed"][k])), max_output_size=int(self.seek["plain"][k]))
        if checksum(plain) != self.seek["checksum"][k]:
            raise ValueError(f"frame {k} is damaged")
        return plain

    def __iter__(self) -> Iterator[tuple[int | None, bytes]]:
        """All documents in order; a frame is decompressed once."""
        held, plain = -1, b""
        for e in self.index:
            if e["frame"] != held:
                held, plain = int(e["frame"]), self.frame(int(e["frame"]))
            first = 4 * int(e["first"])
            yield None if e["null"] else int(e["doc_id"]), plain[first : first + 4 * int(e["n"])]

    def documents(self, doc_id: int) -> list[bytes]:
        """The ids of the documents with this id; no other frames are read."""
        rows = self.index[(self.index["doc_id"] == doc_id) & (self.index["null"] == 0)]
        return [self.frame(int(e["frame"]))[4 * int(e["first"]) :][: 4 * int(e["n"])] for e in rows]


def write(docs: DataFrame, folder: str, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """Writes ``docs`` below ``folder`` (a URI) and returns the manifest: path, bytes, part, documents, ids."""
    end = end_id.to_bytes(4, "little")

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        encoder, part = tokens.encoder(tokens.vocabulary(vocabulary)), TaskContext.get().partitionId()
        fs, place = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(place, recursive=True)
        name = f"{part:06d}-{uuid.uuid4().hex}.zst"
        writer, ids, documents = None, 0, 0
        for batch in batches:
            texts, doc_ids = [t if isinstance(t, str) else "" for t in batch.text], batch.doc_id.tolist()
            del batch
            for a, b in tokens.slices(texts):
                for doc_id, own in zip(doc_ids[a:b], encoder.encode(texts[a:b]), strict=True):
                    if writer is None:
                        stream = fs.open_output_stream(f"{place}/{name}", compression=None)  # else the name's ending adds a second compression
                        writer = Writer(stream)
                    own += end
                    writer.add(None if pd.isna(doc_id) else int(doc_id), own)
                    ids += len(own) // 4
                    documents += 1
        encoder.forget()
        if writer is not None:
            writer.close()
            stream.close()
            size = fs.get_file_info(f"{place}/{name}").size
            yield pd.DataFrame({"path": [f"{folder}/{name}"], "bytes": [size], "part": [part], "documents": [documents], "ids": [ids]})

    # doc_id as Arrow sends it must stay exact next to nulls, hence text
    row = F.xxhash64(*[F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and kind != "variant"])
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), row.alias("_row")).repartitionByRange("doc_id", "_row")
    ready = ordered.sortWithinPartitions("doc_id", "_row").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return scratch.table(ready.mapInPandas(task, "path string, bytes long, part long, documents long, ids long"), "manifest")


def read(manifest: DataFrame) -> DataFrame:
    """Every document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file in batch.itertuples():
                fs, place = pyarrow.fs.FileSystem.from_uri(file.path)
                with fs.open_input_file(place) as source:
                    rows, at = [], int(file.before)
                    for doc_id, ids in Reader(source, int(file.bytes)):
                        rows.append((None if doc_id is None else str(doc_id), at, len(ids) // 4, zlib.crc32(ids)))
                        at += len(ids) // 4
                yield pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32"])

    # one row per file, so this window, a single task, holds the file list alone
    before = F.coalesce(F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = manifest.withColumn("before", before)
    facts = manifest.agg(F.count("*").alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    # a number that is asked for is not coalesced by the manifest's own few bytes
    dealt = files.repartition(max(1, min(facts.files, -(-facts.bytes // READ_BYTES))), "part")
    out = dealt.mapInPandas(task, "doc_id string, start long, n_tokens long, ids_crc32 long")
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "start", "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame) -> DataFrame:
    """Writes the documents to the shared folder and returns what the files hold."""
    return read(write(docs, scratch.new_path(docs.sparkSession, "tokens")))
