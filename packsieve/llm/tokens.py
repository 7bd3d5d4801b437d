"""Token ids of whole texts by a public byte-level or word-end BPE file.

Both vocabularies split a text into pre-tokens before merging, and a pre-token
never reaches over a space that a non-space follows. So a text's ids are those
of its space-separated chunks in order, and each worker keeps the ids of short
chunks that it has met: the library encodes a chunk once, not at every
occurrence. Arrow splits the texts and numbers their different chunks, so Python
looks up each of these once a call, and numpy puts the ids of all occurrences
together. New chunks go to the library many at a time, with a mark of one id
between them, since a call costs more than a chunk. A text with a space before
other white space goes to the library whole, since a run of white space is split
by what follows it; so does one that holds the spelling of an added token
(``<|endoftext|>``), which the library maps to that token's one id.
"""

from __future__ import annotations

import ctypes
import re
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Chunks longer than this are encoded each time; at this many the cache starts anew.
CHUNK_CHARS, CACHE_CHUNKS = 48, 600_000
#: Characters of text encoded at a time, and new chunks in one call.
SLICE_CHARS, CALL_CHUNKS = 4_000_000, 20_000
#: Chunks whose ids are put together at a time.
GATHER = 400_000
MARK = "|"

_RUN = re.compile(r" (?=\s)")
_ENCODERS: dict[str, Encoder] = {}


def slices(texts: Sequence[str], chars: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """(from, to) of runs of texts of about so many characters, one text at least."""
    start = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > chars:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


class _Entries(dict):
    """A chunk's entry, -1 where there is none."""

    def __missing__(self, chunk: str) -> int:
        return -1


class Encoder:
    """Ids as unsigned 32-bit bytes in this machine's order, little-endian on all that Spark supports."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.forget()
        mark = self._encode([f" {MARK}"])[0]
        self.mark = int.from_bytes(mark, "little") if len(mark) == 4 else None

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def uncut(self, text: str) -> bool:
        """Whether a text can't be cut at its spaces."""
        return bool(_RUN.search(text)) or any(a in text for a in self.added)

    def _keep(self, ids: np.ndarray, start: np.ndarray, length: np.ndarray) -> None:
        """Appends to the pool of ids, and the place of each new entry in it."""
        self.start.append(start + self.size)
        self.length.append(length)
        self.pool.append(ids)
        self.size += len(ids)

    def _alone(self, texts: list[str]) -> None:
        """New entries for these texts, each encoded by itself."""
        for at in range(0, len(texts), CALL_CHUNKS):
            ids = self._encode(texts[at : at + CALL_CHUNKS])
            length = np.array([len(x) // 4 for x in ids], dtype=np.int64)
            self._keep(np.frombuffer(b"".join(ids), dtype=np.uint32), np.cumsum(length) - length, length)

    def _learn(self, chunks: list[str]) -> None:
        """New entries for chunks as they stand behind a space."""
        together = [c for c in chunks if MARK not in c] if self.mark is not None else []
        alone = [c for c in chunks if MARK in c] if together else chunks
        for c in (*alone, *together):
            self.cache[c] = len(self.cache)
        self._alone([" " + c for c in alone])
        for at in range(0, len(together), CALL_CHUNKS):
            ids = np.frombuffer(self._encode([" " + f" {MARK} ".join(together[at : at + CALL_CHUNKS])])[0], dtype=np.uint32)
            end = np.append(np.flatnonzero(ids == self.mark), len(ids))
            start = np.append(0, end[:-1] + 1)
            self._keep(ids, start, end - start)

    def forget(self) -> None:
        """Called at a task's end: workers live on, and other stages need the memory."""
        self.cache = _Entries()
        none = np.zeros(0, dtype=np.int64)
        self.start, self.length, self.pool, self.size = [none], [none], [none.astype(np.uint32)], 0
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # where the C library can, what is free goes back to the system
            trim(0)

    def _whole(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and lengths of all entries, and the ids."""
        for parts in (self.start, self.length, self.pool):
            parts[:] = [np.concatenate(parts)]
        return self.start[0], self.length[0], self.pool[0]

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        """The ids of each text; callers bound the characters given at once by ``slices``."""
        if not len(texts):
            return []
        if len(self.cache) > CACHE_CHUNKS:
            self.forget()
        # a text that can't be cut at its spaces is its own first chunk
        whole = {i for i, t in enumerate(texts) if self.uncut(t)}
        split = pc.split_pattern(pa.array(["" if i in whole else t for i, t in enumerate(texts)], pa.large_string()), " ")
        coded, ends = split.values.dictionary_encode(), split.offsets.to_numpy()
        chunks, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        firsts = [texts[i] if i in whole else chunks[codes[k]] for i, k in enumerate(ends[:-1].tolist())]
        rest = np.bincount(np.delete(codes, ends[:-1]), minlength=len(chunks)) > 0  # those that stand behind a space somewhere
        of = np.fromiter(map(self.cache.__getitem__, chunks), dtype=np.int64, count=len(chunks))
        new = np.flatnonzero((of < 0) & rest)
        asked = [chunks[k] for k in new.tolist()]
        is_long = np.fromiter(map(CHUNK_CHARS.__lt__, map(len, asked)), dtype=bool, count=len(asked))
        short, long = ([asked[k] for k in np.flatnonzero(held).tolist()] for held in (~is_long, is_long))
        self._learn(short)
        of[new[~is_long]] = np.fromiter(map(self.cache.__getitem__, short), dtype=np.int64, count=len(short))
        _, _, ids = self._whole()
        held = len(self.cache), len(ids)
        self._alone([" " + c for c in long] + firsts)  # for this call alone
        start, length, ids = self._whole()
        of[new[is_long]] = held[0] + np.arange(len(long))
        entry = of[codes]
        entry[ends[:-1]] = held[0] + len(long) + np.arange(len(texts))
        size = np.concatenate([[0], np.cumsum(length[entry])])
        out = np.empty(size[-1], dtype=np.uint32)
        for a in range(0, len(entry), GATHER):
            e = entry[a : a + GATHER]
            lo, hi = size[a], size[a + len(e)]
            out[lo:hi] = ids[np.repeat(start[e] - size[a : a + len(e)], length[e]) + np.arange(lo, hi)]
        self.start, self.length, self.pool, self.size = [start[: held[0]]], [length[: held[0]]], [ids[: held[1]]], held[1]
        at = size[ends].tolist()
        return [out[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]


def encoder(path: str) -> Encoder:
    """The worker's encoder for this file."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def vocabulary(name: str) -> str:
    """Where a public vocabulary file lies on this machine; called on the executors."""
    import public_tokenizers

    return public_tokenizers.path(name)
