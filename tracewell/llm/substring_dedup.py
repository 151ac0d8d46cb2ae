r"""Removal of passages that an earlier document has, by windows of words.

Copies of a whole text are told by a digest of its words first: all windows of a copy
are those of the document with the smallest key, so the classes of copies that hold most
words, at most `COPY_CLASSES` of them, need no windows but those of one document. Copies
in further classes go the way of all texts.

First pass: each task counts the hashes of its windows, some at a time, in count-min
sketches of saturating counters (none, one, more), which are merged slice by slice.
An estimate is never below the count, so a window estimated to occur once does occur
once. Second pass: windows estimated repeated are exactly grouped by 96 bits of hash.
A task keeps the smallest key it has seen of windows that recur in it; a document that
has such a window after a smaller key is known to repeat it and needs no group. So
however many documents have a window, its group gets about one row from each task.
Only texts that lose words are shuffled, to meet their windows.

The sketch has a few counters per window up to `SKETCH_BITS`; beyond that more
windows pass it, but none is lost. A window is `n` consecutive words
`[^\x20\x09-\x0D]+` of one document; windows are judged on the input. Null and
empty texts have no words; a document with a null key neither loses words nor makes
others lose any; documents with equal keys do not affect each other; an empty table
gives an empty one. Further columns are not looked at.
"""

from __future__ import annotations

import hashlib
import zlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.llm.batches import Batches, documents, keyed_texts, map_batches, record_batch, slices
from tracewell.llm.chunk_cache import HashTable
from tracewell.llm.key_filter import hashed, key_filter, may_hold
from tracewell.llm.words import Splitter, Words, mix, odd_numbers
from tracewell.sources.workspace import materialise

WINDOW = 13
#: Rows of counters, and the log of their number in a row, at most: 64 MB are broadcast then, to every worker.
ROWS, SKETCH_BITS = 2, 28
#: Counters per row for each window there may be.
COUNTERS_PER_WINDOW = 2
#: Slices of a row that are merged apart, and windows of a part that a task sends to them.
SLICES, PART_WINDOWS = 64, 3 << 19
#: Classes of copies that are known to all tasks, 24 bytes each.
COPY_CLASSES = 1 << 17
#: Recurring windows whose smallest key a task keeps; beyond them it starts afresh, which costs rows only.
TASK_WINDOWS = 1 << 17

_SLICE = pa.schema([("slot", pa.int32()), ("once", pa.binary()), ("more", pa.binary())])
_DIGESTS = pa.schema([("d1", pa.int64()), ("d2", pa.int64()), ("key", pa.int64()), ("n", pa.int64())])
_CANDIDATES = pa.schema([("k1", pa.int64()), ("k2", pa.int32()), ("key", pa.int64()), ("repeats", pa.bool_())])
_KEPT = pa.schema([("key", pa.int64()), ("kept", pa.string()), ("n_words", pa.int64()), ("n_removed", pa.int64())])


def _counter(hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
    spread = hashes * odd_numbers(1, 50 + row)[0] if row else hashes
    return (spread >> np.uint64(64 - bits)).astype(np.int64)


def _set(bitmap: np.ndarray, at: np.ndarray) -> None:
    """Set the bits at sorted, distinct places."""
    if len(at):
        byte = at >> 3
        first = np.flatnonzero(np.concatenate(([True], byte[1:] != byte[:-1])))
        bitmap[byte[first]] |= np.bitwise_or.reduceat((1 << (at & 7)).astype(np.uint8), first)


def _get(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def _packed(at: np.ndarray) -> bytes:
    """The gaps between sorted, distinct places, a byte each; 255 says that the gap goes on."""
    gaps = np.diff(at, prepend=0)
    more = gaps // 255
    out = np.full(len(gaps) + int(more.sum()), 255, np.uint8)
    out[np.cumsum(more + 1) - 1] = gaps % 255
    return out.tobytes()


def _unpacked(data: bytes, size: int) -> np.ndarray:
    """A bitmap of `size` bytes with the bits set at the packed places."""
    gaps = np.frombuffer(data, np.uint8)
    bitmap = np.zeros(size, np.uint8)
    _set(bitmap, np.cumsum(gaps, dtype=np.int64)[gaps < 255])
    return bitmap


def counted(hashes: np.ndarray, several: np.ndarray, row: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The counters that some windows reach, and those that count more than one; `several` says which windows do."""
    at = (_counter(hashes, row, bits) << 1) | several
    at.sort()
    several = (at & 1).astype(bool)
    at >>= 1
    first = np.ones(len(at), bool)
    first[1:] = at[1:] != at[:-1]
    # Of equal counters the windows that count several come last.
    last = np.append(first[1:], True)
    more = several[last] | ~first[last]
    once = at[first]
    return once, once[more]


# Copies of whole texts


def _digests(words: Words, n: int) -> np.ndarray:
    """128 bits for each text of at least n words, and zeros for others."""
    found = np.zeros((len(words.counts), 2), np.int64)
    for i in np.flatnonzero(words.counts >= n).tolist():
        held = words.hashes[words.bounds[i] : words.bounds[i + 1]]
        found[i] = np.frombuffer(hashlib.blake2b(held, digest_size=16).digest(), np.int64)
    return found


class Copies:
    """The digests of some classes of copies, and the smallest key of each."""

    def __init__(self, d1: np.ndarray, d2: np.ndarray, first: np.ndarray):
        order = np.argsort(d1, kind="stable")
        self.d1, self.d2, self.first = d1[order], d2[order], first[order]

    def among(self, words: Words, keys: pa.Array, n: int) -> np.ndarray:
        """Which texts are copies of one with a smaller key."""
        found = np.zeros(len(words.counts), bool)
        if len(self.d1):
            digests = _digests(words, n)
            at = np.minimum(np.searchsorted(self.d1, digests[:, 0]), len(self.d1) - 1)
            same = (self.d1[at] == digests[:, 0]) & (self.d2[at] == digests[:, 1]) & (words.counts >= n)
            key = keys.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
            found = same & (key > self.first[at])
        return found


def copies(texts: DataFrame, n: int = WINDOW, most: int = COPY_CLASSES) -> Copies:
    """The classes of copies whose windows are most."""

    def run(batches: Batches) -> Batches:
        for batch in slices(batches):
            words = Splitter()(batch.column("text"))
            digests, long = _digests(words, n), pa.array(words.counts >= n)
            rows = record_batch(_DIGESTS, digests[:, 0], digests[:, 1], batch.column("key"), words.counts)
            yield rows.filter(long)

    rows = map_batches(texts.where("key IS NOT NULL"), run, "d1 long, d2 long, key long, n long")
    classes = rows.groupBy("d1", "d2").agg(F.min("key").alias("first"), (F.sum("n") - F.min("n")).alias("spared"))
    top = classes.where("spared > 0").orderBy(F.desc("spared"), "d1", "d2").limit(most).toArrow()
    return Copies(*[top.column(name).to_numpy() for name in ("d1", "d2", "first")])


def _windows(batch: pa.RecordBatch, n: int, known: Copies) -> tuple[Words, np.ndarray, np.ndarray]:
    """Words, window hashes, and where windows begin in texts that are no copies."""
    words = Splitter()(batch.column("text"))
    hashes, whole = words.windows(n)
    whole &= ~np.repeat(known.among(words, batch.column("key"), n), words.counts)
    return words, hashes, np.flatnonzero(whole)


# Windows that may be repeated


def _sketched(n: int, bits: int, known: Copies):
    """Sparse parts of the sketch, each of some windows, slice by slice."""
    slot_bits = bits - SLICES.bit_length() + 1

    def part(hashes: list[np.ndarray]) -> Batches:
        found = np.concatenate(hashes)
        hashes.clear()
        found.sort()
        new = np.ones(len(found), bool)
        new[1:] = found[1:] != found[:-1]
        several = ~np.append(new[1:], True)[new]
        found = found[new]
        for row in range(ROWS):
            once, more = counted(found, several, row, bits)
            edges = np.arange(SLICES + 1) << slot_bits
            once_at, more_at = np.searchsorted(once, edges), np.searchsorted(more, edges)
            columns = [], [], []
            for i in np.flatnonzero(np.diff(once_at)).tolist():
                columns[0].append(row * SLICES + i)
                columns[1].append(_packed(once[once_at[i] : once_at[i + 1]] - edges[i]))
                columns[2].append(_packed(more[more_at[i] : more_at[i + 1]] - edges[i]))
            yield record_batch(_SLICE, *columns)

    def run(batches: Batches) -> Batches:
        held, size = [], 0
        for batch in slices(batches):
            _, hashes, at = _windows(batch, n, known)
            held.append(hashes[at])
            size += len(at)
            if size > PART_WINDOWS:
                yield from part(held)
                held, size = [], 0
        if size:
            yield from part(held)

    return run


def _merged(size: int, batches: Batches) -> Batches:
    """Rows of one slot come one after the other; a slot has `size` bytes."""
    slot = once = more = None

    def result():
        return record_batch(_SLICE, [slot], [b""], [zlib.compress(more.tobytes(), 1)])

    for batch in batches:
        for row in batch.to_pylist():
            next_once, next_more = (_unpacked(row[c], size) for c in ("once", "more"))
            if row["slot"] != slot:
                if slot is not None:
                    yield result()
                slot, once, more = row["slot"], next_once, next_more
            else:
                more |= next_more | (once & next_once)
                once |= next_once
    if slot is not None:
        yield result()


def sketch_bits(texts: DataFrame) -> int:
    """Log of the counters in a row; a window takes four bytes of text at the least, mostly more."""
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return min(SKETCH_BITS, max(16, int(size * COUNTERS_PER_WINDOW // 6).bit_length()))


def repeated_counters(texts: DataFrame, n: int, bits: int | None, known: Copies) -> tuple[int, bytes]:
    """Log of the counters in a row, and a bit for each counter that says it counted two or more."""
    bits = bits or sketch_bits(texts)
    sketches = map_batches(texts, _sketched(n, bits, known), "slot int, once binary, more binary")
    dealt = sketches.repartitionById(ROWS * SLICES, "slot").sortWithinPartitions("slot")
    size = max(1, (1 << bits - 3) // SLICES)
    merge = partial(_merged, size)
    merged = map_batches(dealt, merge, "slot int, once binary, more binary").select("slot", "more").toArrow()
    found = np.zeros((ROWS, 1 << bits - 3), np.uint8)
    for slot, more in zip(merged.column("slot").to_pylist(), merged.column("more").to_pylist(), strict=True):
        start = slot % SLICES * size
        found[slot // SLICES, start : start + size] = np.frombuffer(zlib.decompress(more), np.uint8)
    return bits, found.tobytes()


class SmallestKeys:
    """The smallest key that a task has seen of each of some windows."""

    def __init__(self, most: int = TASK_WINDOWS):
        self.most = most
        self._clear()

    def _clear(self) -> None:
        self.table, self.keys = HashTable(12), np.zeros(0, np.int64)

    def seen(self, hashes: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Whether a smaller key is known for each window; windows given twice are kept from now on.

        Rows are in the order of hashes and then keys.
        """
        first = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1]))) if len(hashes) else np.zeros(0, int)
        counts = np.diff(np.append(first, len(hashes)))
        places = self.table.find(hashes[first])
        old = places >= 0
        least = keys[first].copy()
        least[old] = np.minimum(least[old], self.keys[places[old]])
        self.keys[places[old]] = least[old]
        found = keys > np.repeat(least, counts)
        new = ~old & (counts > 1)
        if len(self.keys) + new.sum() > self.most:
            self._clear()
        start = len(self.keys)
        self.keys = np.concatenate((self.keys, least[new]))
        self.table.add(hashes[first[new]], np.arange(start, len(self.keys), dtype=np.int32))
        return found


def candidates(texts: DataFrame, n: int, bits: int | None, known: Copies) -> DataFrame:
    """(k1, k2, key, repeats) of windows that may be repeated, once per document.

    `repeats` says that a smaller key is known to have the window.
    """
    shared = texts.sparkSession.sparkContext.broadcast((*repeated_counters(texts, n, bits, known), known))

    def run(batches: Batches) -> Batches:
        bits, packed, known = shared.value
        more = np.frombuffer(packed, np.uint8).reshape(ROWS, -1)
        weights = odd_numbers(n, 99)
        smallest = SmallestKeys(TASK_WINDOWS)
        for batch in slices(batches):
            words, hashes, at = _windows(batch, n, known)
            for row in range(ROWS):
                at = at[_get(more[row], _counter(hashes[at], row, bits))]
            keys = batch.column("key").to_numpy()[np.searchsorted(words.bounds, at, "right") - 1]
            order = np.lexsort((keys, hashes[at]))
            at, keys = at[order], keys[order]
            new = np.ones(len(at), bool)
            new[1:] = (keys[1:] != keys[:-1]) | (hashes[at[1:]] != hashes[at[:-1]])
            at, keys = at[new], keys[new]
            other = np.zeros(len(at), np.uint64)
            for i in range(n):
                other += words.hashes[at + i] * weights[i]
            k2 = (other >> np.uint64(32)).astype(np.uint32)
            # A mix of all 96 bits that the groups go by.
            repeats = smallest.seen(mix(hashes[at] ^ (k2.astype(np.uint64) << np.uint64(32))), keys)
            yield record_batch(_CANDIDATES, hashes[at].view(np.int64), k2.view(np.int32), keys, repeats)

    return map_batches(texts, run, "k1 long, k2 int, key long, repeats boolean")


def repeated_windows(
    texts: DataFrame, n: int = WINDOW, bits: int | None = None, known: Copies | None = None
) -> DataFrame:
    """(key, k1): windows of each document that one with a smaller key has too, but for those of copies."""
    texts = texts.where("key IS NOT NULL")
    found = candidates(texts, n, bits, copies(texts, n) if known is None else known)
    # Rows that are known to repeat a window need no group; their own key spreads them.
    spread = found.withColumn("salt", F.when(F.col("repeats"), F.col("key")))
    group = Window.partitionBy("k1", "k2", "salt").orderBy("key")
    first = F.first("key").over(group.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    marked = spread.select("key", "k1", "repeats", first.alias("first"))
    return marked.where(F.col("repeats") | (F.col("key") > F.col("first"))).select("key", "k1")


def _without(n: int, shared):
    """Texts without the words of the windows in `gone`; copies lose all words."""

    def run(batches: Batches) -> Batches:
        known = shared.value[0]
        for batch in slices(batches):
            words = Splitter()(batch.column("text"))
            hashes, whole = words.windows(n)
            at = np.flatnonzero(whole)
            gone = batch.column("gone")
            counts = np.diff(gone.offsets.to_numpy())
            counts[np.asarray(gone.is_null())] = 0
            sets = gone.flatten().to_numpy().view(np.uint64)
            owner = np.searchsorted(words.bounds, at, "right") - 1
            hit = _in_sets(hashes[at], owner, sets, np.repeat(np.arange(len(counts)), counts))
            edges = np.zeros(len(words.hashes) + 1, np.int64)
            edges[at[hit]] += 1
            np.subtract.at(edges, at[hit] + n, 1)
            covered = np.cumsum(edges[:-1]) > 0
            covered |= np.repeat(known.among(words, batch.column("key"), n), words.counts)
            yield record_batch(_KEPT, batch.column("key"), *_joined(words, ~covered))

    return run


def _may_lose(batch: pa.RecordBatch, shared) -> np.ndarray:
    """Which texts may lose words by windows of theirs."""
    return may_hold(shared.value[1], batch.column("hash")) & np.asarray(batch.column("key").is_valid())


def _touched(shared):
    """The rows that may lose words by windows of theirs."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            yield batch.select(["key", "text"]).filter(pa.array(_may_lose(batch, shared)))

    return run


def _others(n: int, shared):
    """The other rows, without the words they lose; in one step, so that a task needs one worker."""

    def left(batches: Batches) -> Batches:
        for batch in batches:
            part = batch.select(["key", "text"]).filter(pa.array(~_may_lose(batch, shared)))
            yield part.append_column("gone", pa.nulls(part.num_rows, pa.list_(pa.int64())))

    def run(batches: Batches) -> Batches:
        yield from _without(n, shared)(left(batches))

    return run


def _in_sets(values: np.ndarray, owner: np.ndarray, sets: np.ndarray, set_owner: np.ndarray) -> np.ndarray:
    """Whether each value is in its owner's set."""
    order = np.lexsort((sets, set_owner))
    sets, set_owner = sets[order], set_owner[order]
    found = np.zeros(len(values), bool)
    if len(sets):
        known, number = np.unique(sets, return_inverse=True)
        place = np.minimum(np.searchsorted(known, values), len(known) - 1)
        pairs = set_owner * len(known) + number
        at = owner * len(known) + place
        found = (known[place] == values) & np.isin(at, pairs)
    return found


def _joined(words: Words, kept: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Texts of the kept words with one space between, the number of all words and of the others."""
    owner = np.repeat(np.arange(len(words.counts)), words.counts)
    at = np.flatnonzero(kept)
    follows = np.zeros(len(at), bool)
    follows[:-1] = owner[at[1:]] == owner[at[:-1]]
    raw = words.raw.copy()
    # A word that another follows has a separator after it.
    raw[words.ends[at[follows]]] = 32
    edges = np.zeros(len(raw) + 2, np.int64)
    edges[words.starts[at]] += 1
    np.subtract.at(edges, words.ends[at] + follows, 1)
    inside = np.cumsum(edges[:-2]) > 0
    sizes = words.ends[at] - words.starts[at] + follows
    bounds = np.concatenate(([0], np.cumsum(np.bincount(owner[at], sizes, len(words.counts)).astype(np.int64))))
    data, offsets = raw[inside], bounds.astype(np.int32)
    texts = pa.Array.from_buffers(pa.string(), len(words.counts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    left = np.bincount(owner[at], minlength=len(words.counts))
    return texts, words.counts, words.counts - left


def remove_repeated(
    df: DataFrame, key: str = "doc_id", text: str = "text", n: int = WINDOW, bits: int | None = None
) -> DataFrame:
    """(key, kept, n_words, n_removed): each text without the words of windows that an earlier one has."""
    texts = keyed_texts(df, key, text)
    known = copies(texts, n)
    # No more windows than the document has.
    sets = repeated_windows(texts, n, bits, known).groupBy("key").agg(F.collect_list("k1").alias("gone"))
    sets = materialise(sets, "windows")
    shared = df.sparkSession.sparkContext.broadcast((known, key_filter(sets, "key")))
    rows = hashed(texts, "key")
    schema = "key long, kept string, n_words long, n_removed long"
    touched = map_batches(rows, _touched(shared), "key long, text string").join(sets, "key", "left")
    touched = map_batches(touched.select("key", "text", "gone"), _without(n, shared), schema)
    others = map_batches(rows, _others(n, shared), schema)
    return touched.unionByName(others).withColumnRenamed("key", key)


def op6_countmin_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeated(documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def repeated_sql(documents: str = "documents", n: int = WINDOW) -> str:
    """The same in SQL."""
    return rf"""
WITH w AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws
    FROM {documents}
),
win AS (
    SELECT r, doc_id, i, array_to_string(ws[i:i + {n - 1}], ' ') AS k
    FROM (SELECT r, doc_id, ws, unnest(range(1, len(ws) - {n - 2})) AS i FROM w)
),
first AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k),
gone AS (
    SELECT DISTINCT r, i + j AS i
    FROM win JOIN first USING (k), (SELECT unnest(range({n})) AS j)
    WHERE doc_id > m
),
word AS (SELECT r, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
kept AS (
    SELECT r, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n
    FROM word ANTI JOIN gone USING (r, i) GROUP BY r
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
    sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (r)"""
