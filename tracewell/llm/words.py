"""Words of whole texts as 64-bit hashes, for a batch of documents at once.

A batch is the byte buffer of an Arrow string column. A word's hash takes its bytes
eight at a time, all words of the batch together, and mixes them with its length by a
bijection after each step; words of more than `LANES` steps are few and are hashed by
XXH3. So two words of at most eight bytes and equal length never collide, and others do
with a chance near 2**-64, as for a random function: repeated, swapped or periodic
stretches of bytes make it no greater.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from xxhash import xxh3_64_intdigest

#: What separates words where a contract says `[^\x20\x09-\x0D]+`.
SPACES = b" \t\n\x0b\x0c\r"

#: Steps of eight bytes; longer words are hashed one by one.
LANES = 8

_MIX = np.uint64(0xFF51AFD7ED558CCD)
_MIX_2 = np.uint64(0xC4CEB9FE1A85EC53)
_SHIFT, _SHIFT_2 = np.uint64(32), np.uint64(33)
_SEED, _LENGTH = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Keeps the first bytes of a step of which so many belong to the word.
_KEPT = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all bits."""
    x = (x ^ (x >> _SHIFT)) * _MIX
    return x ^ (x >> _SHIFT)


def _scramble(x: np.ndarray) -> np.ndarray:
    """A bijection after which every bit depends on all bits."""
    x = (x ^ (x >> _SHIFT_2)) * _MIX
    x = (x ^ (x >> _SHIFT_2)) * _MIX_2
    return x ^ (x >> _SHIFT_2)


def stretch_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes from each start to its end."""
    sizes = ends - starts
    found = _scramble(_SEED + sizes.astype(np.uint64) * _LENGTH)
    padded = np.concatenate((raw, np.zeros(8, np.uint8)))
    eights = np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))
    rest = np.flatnonzero((sizes > 0) & (sizes <= 8 * LANES))
    at, left = starts[rest], sizes[rest]
    while len(rest):
        found[rest] = _scramble(found[rest] ^ (eights.take(at) & _KEPT[np.minimum(left, 8)]))
        on = left > 8
        rest, at, left = rest[on], at[on] + 8, left[on] - 8
    for i in np.flatnonzero(sizes > 8 * LANES).tolist():
        found[i] = xxh3_64_intdigest(raw[starts[i] : ends[i]], 1)
    return found


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each begins and the last ends; null as empty."""
    texts = texts.cast(pa.large_string())
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
    base, end = int(offsets[0]), int(offsets[-1])
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8, end - base, base) if end > base else np.zeros(0, np.uint8)
    return raw, offsets - base


@dataclass
class Splitter:
    """Splits at the bytes of `separators`; `fold` takes A-Z as a-z.

    `breaks` are signs that begin a word of their own after a letter A-Z or a-z.
    """

    separators: bytes = SPACES
    fold: bool = False
    breaks: bytes = b""

    def __post_init__(self):
        self.folded = np.arange(256, dtype=np.uint8)
        self.folded[65:91] = self.folded[97:123]
        letters = np.zeros(256, bool)
        letters[65:91] = letters[97:123] = True
        self.letters, self.signs = letters, np.zeros(256, bool)
        self.signs[list(self.breaks)] = True
        self.splits = np.zeros(256, bool)
        self.splits[list(self.separators)] = True

    def __call__(self, texts: pa.Array, exact: bytes = b"") -> Words:
        """The words of all texts; a null text has none.

        Where the texts hold the bytes `exact`, letters are not folded.
        """
        raw, offsets = text_bytes(texts)
        inside = np.concatenate(([False], ~self.splits[raw], [False]))
        edge = np.zeros(len(raw) + 1, bool)
        edge[offsets] = True
        if self.breaks:
            edge[1:-1] |= self.letters[raw[:-1]] & self.signs[raw[1:]]
        starts = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
        ends = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
        fold = self.fold and not (exact and exact in raw.tobytes())
        hashes = stretch_hashes(self.folded[raw] if fold else raw, starts, ends)
        return Words(raw, offsets, starts, ends, hashes, np.searchsorted(starts, offsets))


@dataclass
class Words:
    raw: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    #: Words `bounds[i]` to `bounds[i + 1]` are those of text i.
    bounds: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def windows(self, n: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the n words from each word on, and whether they are of one text."""
        whole = np.zeros(len(self.hashes), bool)
        if len(self.hashes) < n:
            return np.zeros(len(self.hashes), np.uint64), whole
        combined = np.zeros(len(self.hashes) - n + 1, np.uint64)
        weights = odd_numbers(n, seed)
        for i in range(n):
            combined += self.hashes[i : len(self.hashes) - n + 1 + i] * weights[i]
        owner = np.repeat(np.arange(len(self.counts)), self.counts)
        whole[: len(combined)] = owner[: len(combined)] == owner[n - 1 :]
        return np.concatenate((mix(combined), np.zeros(n - 1, np.uint64))), whole


def odd_numbers(n: int, seed: int) -> np.ndarray:
    return np.frombuffer(np.random.RandomState(1000 + seed).bytes(8 * n), np.uint64) | np.uint64(1)
