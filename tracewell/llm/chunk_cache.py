"""Token ids of space-delimited chunks, looked up for a whole batch at a time.

A tokenizer that never joins characters across white space gives a text the ids
of its chunks, one after the other. Chunks recur, so each worker keeps those it
has met in an open-addressed table from the chunk's 64-bit hash to its ids; only
chunks that are new to the worker go through the library.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from tracewell.llm.words import Words

#: Chunks a worker keeps; beyond them it starts afresh, which costs time only.
CACHE_CHUNKS = 3 << 18


class HashTable:
    """64-bit hashes to small numbers, with linear probing."""

    def __init__(self, bits: int):
        self.mask = np.int64((1 << bits) - 1)
        self.keys = np.zeros(1 << bits, np.uint64)
        self.values = np.zeros(1 << bits, np.int32)
        self.used = 0

    def _slots(self, hashes: np.ndarray) -> np.ndarray:
        return hashes.view(np.int64) & self.mask

    @staticmethod
    def _nonzero(hashes: np.ndarray) -> np.ndarray:
        return np.where(hashes == 0, np.uint64(1), hashes)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The value of each hash, or -1."""
        hashes = self._nonzero(hashes)
        found = np.full(len(hashes), -1, np.int32)
        rest, slots = np.arange(len(hashes)), self._slots(hashes)
        while len(rest):
            keys = self.keys[slots]
            hit = keys == hashes[rest]
            found[rest[hit]] = self.values[slots[hit]]
            on = ~hit & (keys != 0)
            rest, slots = rest[on], (slots[on] + 1) & self.mask
        return found

    def add(self, hashes: np.ndarray, values: np.ndarray) -> None:
        """`hashes` are distinct and new."""
        if 2 * (self.used + len(hashes)) > len(self.keys):
            old = self.keys != 0
            keys, kept = self.keys[old], self.values[old]
            bits = int(2 * (self.used + len(hashes))).bit_length()
            self.__init__(bits)
            self.add(keys, kept)
        self.used += len(hashes)
        hashes = self._nonzero(hashes)
        rest, slots = np.arange(len(hashes)), self._slots(hashes)
        while len(rest):
            free = self.keys[slots] == 0
            self.keys[slots[free]] = hashes[rest[free]]
            placed = free & (self.keys[slots] == hashes[rest])
            self.values[slots[placed]] = values[rest[placed]]
            rest, slots = rest[~placed], (slots[~placed] + 1) & self.mask


class ChunkCache:
    """`encode` gives the ids of each of some chunks of UTF-8 bytes."""

    def __init__(self, encode: Callable[[list[bytes]], list[list[int]]], limit: int = CACHE_CHUNKS):
        self.encode, self.limit = encode, limit
        self._clear()

    def _clear(self) -> None:
        self.table = HashTable(16)
        self.begins = np.zeros(1 << 16, np.int64)
        self.sizes = np.zeros(1 << 16, np.int32)
        self.pool = np.zeros(1 << 18, np.int32)
        self.entries = self.filled = 0

    @staticmethod
    def _room(array: np.ndarray, n: int) -> np.ndarray:
        if n <= len(array):
            return array
        grown = np.zeros(max(n, 2 * len(array)), array.dtype)
        grown[: len(array)] = array
        return grown

    def entries_of(self, words: Words, at: np.ndarray | None = None) -> np.ndarray:
        """The cache entry of each word (of those at `at`), after adding new ones."""
        if self.entries > self.limit:
            self._clear()
        hashes = words.hashes if at is None else words.hashes[at]
        found = self.table.find(hashes)
        missing = np.flatnonzero(found < 0)
        if len(missing):
            new, first = np.unique(hashes[missing], return_index=True)
            places = missing[first] if at is None else at[missing[first]]
            data = words.raw.tobytes()
            edges = zip(words.starts[places].tolist(), words.ends[places].tolist(), strict=True)
            ids = self.encode([data[s:e] for s, e in edges])
            sizes = np.fromiter(map(len, ids), np.int32, len(ids))
            end, total = self.entries + len(ids), self.filled + int(sizes.sum())
            self.begins, self.sizes = self._room(self.begins, end), self._room(self.sizes, end)
            self.pool = self._room(self.pool, total)
            self.pool[self.filled : total] = np.fromiter(
                (i for one in ids for i in one), np.int32, total - self.filled
            )
            self.sizes[self.entries : end] = sizes
            self.begins[self.entries : end] = self.filled + np.cumsum(sizes) - sizes
            self.table.add(new, np.arange(self.entries, end, dtype=np.int32))
            self.entries, self.filled = end, total
            found = self.table.find(hashes)
        return found

    def ids(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the batch in order, and where each word's ids end."""
        entries = self.entries_of(words)
        sizes = self.sizes[entries].astype(np.int64)
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        places = np.repeat(self.begins[entries] - (ends - sizes), sizes) + np.arange(total)
        return self.pool[places], ends


def per_text(words: Words, ends: np.ndarray) -> np.ndarray:
    """Where the ids of each text begin, and where the last ends."""
    return np.concatenate(([0], ends))[words.bounds]
