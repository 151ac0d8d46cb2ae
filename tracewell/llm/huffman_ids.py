"""Token ids in binary files, as canonical Huffman codes of limited length.

Ids are counted over all documents, and package-merge gives the best code lengths
up to `MAX_BITS`; codes follow from the lengths alone, so each file carries only
those. A document's codes begin at a 32-bit word. Every `LANE` ids a checkpoint
tells how many bits they take; all stretches between checkpoints are decoded side
by side, one table lookup per id and step.

A file: magic, code lengths; blocks of whole documents, each to be decoded on its
own; an index of documents and blocks; the place of the index, magic. Files hold
ascending ranges of keys and are committed as `files.py` says.

Null and empty texts give the end id alone. Rows with equal keys stay separate
rows, ordered by their codes; null keys come first. An empty table gives no files
and no rows. Further columns are not looked at.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.batches import Batches, documents, keyed_texts, map_batches, record_batch, slices
from tracewell.llm.chunk_cache import ChunkCache, per_text
from tracewell.llm.files import FILE_COLUMNS, ShardFile, one_file_per_task, opened, publish, starts
from tracewell.llm.ranges import range_bounds, range_of
from tracewell.llm.word_bpe import SPECIAL, chunks, word_bpe
from tracewell.sources.workspace import fresh_path

MAX_BITS = 16
#: Ids between two checkpoints, ids of a block, ids of a file.
LANE, BLOCK_IDS, FILE_IDS = 64, 1 << 18, 1 << 23
END_ID = 1
_MAGIC = b"HUFFIDS1"

_IDS = pa.schema([("key", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
_TOTALS = pa.schema([("id", pa.int32()), ("n", pa.int64())])
_CODED = pa.schema(
    [("key", pa.int64()), ("shard", pa.int32()), ("n_tokens", pa.int64()), ("codes", pa.binary()), ("lanes", pa.binary())]
)


# Codes


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Best lengths of at most `max_bits` for ids with these counts; 0 for ids that never occur."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << max_bits:
        raise ValueError(f"{len(used)} ids need more than {max_bits} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    own = counts[order].astype(np.int64)
    weights, levels = own, [np.ones(len(own), bool)]
    for _ in range(max_bits - 1):
        packages = weights[: len(weights) // 2 * 2].reshape(-1, 2).sum(axis=1)
        weights = np.concatenate((own, packages))
        is_own = np.arange(len(weights)) < len(own)
        by_weight = np.argsort(weights, kind="stable")
        weights = weights[by_weight]
        levels.append(is_own[by_weight])
    taken = 2 * len(own) - 2
    for level in reversed(levels):
        n = int(level[:taken].sum())
        lengths[order[:n]] += 1
        taken = 2 * (taken - n)
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of length, then of id."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    codes = np.zeros(len(lengths), np.uint64)
    if len(order):
        top = int(lengths[order[-1]])
        steps = np.uint64(1) << (top - lengths[order].astype(np.uint64))
        codes[order] = (np.cumsum(steps) - steps) >> (top - lengths[order].astype(np.uint64))
    return codes


class Coder:
    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.int64)
        self.codes = canonical_codes(lengths)
        self.bits = max(1, int(self.lengths.max(initial=1)))

    def encode(self, ids: np.ndarray, bounds: np.ndarray):
        """Words of codes of all texts, where each text's words begin, and its checkpoints.

        Text i has the ids from `bounds[i]` to `bounds[i + 1]`.
        """
        sizes = self.lengths[ids]
        ends = np.cumsum(sizes)
        before = np.concatenate(([0], ends))[bounds]
        words = np.concatenate(([0], np.cumsum((np.diff(before) + 31) // 32)))
        counts = np.diff(bounds)
        at = ends - sizes + np.repeat(words[:-1] * 32 - before[:-1], counts)
        word, shift = at >> 5, at & 31
        field = self.codes[ids] << (64 - shift - sizes).astype(np.uint64)
        first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1]))) if len(word) else word
        fields = np.zeros(int(words[-1]) + 1, np.uint64)
        if len(first):
            fields[word[first]] = np.add.reduceat(field, first)
        low, high = fields & np.uint64(0xFFFFFFFF), fields >> np.uint64(32)
        high[1:] += low[:-1]
        lanes = (counts + LANE - 1) // LANE
        lane_bounds = np.concatenate(([0], np.cumsum(lanes)))
        lane_first = np.arange(lane_bounds[-1]) - np.repeat(lane_bounds[:-1], lanes)
        begin = np.repeat(bounds[:-1], lanes) + lane_first * LANE
        stop = np.minimum(begin + LANE, np.repeat(bounds[1:], lanes))
        all_ends = np.concatenate(([0], ends))
        return high[:-1].astype(">u4"), words, (all_ends[stop] - all_ends[begin]).astype("<u2"), lane_bounds

    @property
    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """Id and length of the code that each `bits` bits begin with."""
        if not hasattr(self, "_table"):
            ids = np.flatnonzero(self.lengths)
            ids = ids[np.lexsort((ids, self.lengths[ids]))]
            spans = 1 << (self.bits - self.lengths[ids])
            found = np.repeat(ids, spans)
            rest = (1 << self.bits) - len(found)
            found = np.concatenate((found, np.zeros(rest, np.int64))).astype(np.uint32)
            self._table = found, self.lengths[found]
        return self._table

    def decode(self, words: bytes, word_starts: np.ndarray, counts: np.ndarray, lanes: np.ndarray) -> np.ndarray:
        """All ids of texts whose codes begin at `word_starts`; `lanes` has the bits of each stretch."""
        data = np.frombuffer(words, ">u4").astype(np.uint64)
        data = np.concatenate((data, np.zeros(3, np.uint64)))
        pairs = (data[:-1] << np.uint64(32)) | data[1:]
        per_text = (counts + LANE - 1) // LANE
        bounds = np.concatenate(([0], np.cumsum(per_text)))
        bits = np.concatenate(([0], np.cumsum(lanes.astype(np.int64))))
        at = bits[:-1] + np.repeat(word_starts * 32 - bits[bounds[:-1]], per_text)
        left = np.repeat(counts, per_text) - (np.arange(len(at)) - np.repeat(bounds[:-1], per_text)) * LANE
        ids, sizes = self.table
        out = np.zeros((LANE, len(at)), np.uint32)
        down, last = np.uint64(64 - self.bits), len(pairs) - 1
        for step in range(LANE):
            peek = (pairs[np.minimum(at >> 5, last)] << (at & 31).astype(np.uint64)) >> down
            out[step] = ids[peek]
            at = at + sizes[peek]
        inside = np.arange(LANE)[None, :] < left[:, None]
        return out.T[inside]


# From texts to files


@lru_cache(1)
def _cache(path: str) -> ChunkCache:
    return ChunkCache(word_bpe(path))


def tokenised(df: DataFrame, path: str, key: str, text: str) -> DataFrame:
    """(key, n_tokens, ids) with the end id appended; ids as unsigned 32-bit integers."""

    def run(batches: Batches) -> Batches:
        split, cache = chunks(), _cache(path)
        for batch in slices(batches):
            words = split(batch.column("text"), SPECIAL)
            ids, ends = cache.ids(words)
            bounds = per_text(words, ends)
            ids = np.insert(ids, bounds[1:], END_ID).astype("<u4")
            bounds = bounds + np.arange(len(bounds))
            yield record_batch(_IDS, batch.column("key"), np.diff(bounds), _binary(ids, bounds))

    return map_batches(keyed_texts(df, key, text), run, "key long, n_tokens long, ids binary")


def _binary(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    offsets = (bounds * values.dtype.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(values)])


def _ids_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    counts = batch.column("n_tokens").to_numpy()
    data = b"".join(batch.column("ids").to_pylist())
    return np.frombuffer(data, "<u4"), np.concatenate(([0], np.cumsum(counts)))


def id_counts(tokens: DataFrame) -> np.ndarray:
    """How often each id occurs in all documents; as many numbers as the vocabulary has."""

    def run(batches: Batches) -> Batches:
        totals = np.zeros(0, np.int64)
        for batch in slices(batches, "ids"):
            more = np.bincount(_ids_of(batch)[0])
            if len(more) > len(totals):
                totals, more = more, totals
            totals[: len(more)] += more
        used = np.flatnonzero(totals)
        yield record_batch(_TOTALS, used, totals[used])

    found = map_batches(tokens, run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    ids, n = found.column("id").to_numpy(), found.column("n").to_numpy()
    counts = np.zeros(int(ids.max(initial=-1)) + 1, np.int64)
    counts[ids] = n
    return counts


def _coded(lengths: bytes) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        coder = Coder(np.frombuffer(lengths, np.uint8))
        for batch in slices(batches, "ids"):
            ids, bounds = _ids_of(batch)
            words, word_bounds, lanes, lane_bounds = coder.encode(ids, bounds)
            yield record_batch(
                _CODED,
                batch.column("key"),
                batch.column("shard"),
                batch.column("n_tokens"),
                _binary(words, word_bounds),
                _binary(lanes, lane_bounds),
            )

    return run


class _IdFile:
    """Writes blocks of documents, then the index."""

    def __init__(self, root: str, shard: int, lengths: bytes):
        self.file = ShardFile(root, shard, 0, "ids")
        packed = zlib.compress(lengths)
        self.file.write(_MAGIC + len(packed).to_bytes(8, "little") + packed)
        self.rows, self.blocks = [], []
        self._fresh()

    def _fresh(self) -> None:
        self.codes, self.lanes, self.ids, self.first = [], [], 0, len(self.rows)

    def add(self, key: int | None, n: int, codes: bytes, lanes: bytes) -> None:
        self.file.count(key, n)
        self.rows.append((key, n))
        self.codes.append(codes)
        self.lanes.append(lanes)
        self.ids += n
        if self.ids >= BLOCK_IDS:
            self._flush()

    def _flush(self) -> None:
        if self.codes:
            codes, lanes = b"".join(self.codes), b"".join(self.lanes)
            self.blocks.append((self.file.bytes, len(codes), len(lanes), self.first, len(self.rows)))
            self.file.write(codes)
            self.file.write(lanes)
        self._fresh()

    def close(self) -> pa.RecordBatch:
        self._flush()
        at = self.file.bytes
        index = {"keys": [k for k, _ in self.rows], "counts": [n for _, n in self.rows], "blocks": self.blocks}
        packed = zlib.compress(json.dumps(index).encode())
        self.file.write(packed)
        self.file.write(at.to_bytes(8, "little") + _MAGIC)
        return self.file.close()


def write_ids(tokens: DataFrame, root: str, file_ids: int = FILE_IDS) -> DataFrame:
    """Write (key, n_tokens, ids) to files below `root` in ascending order of key; their manifest."""
    counts = id_counts(tokens)
    lengths = code_lengths(counts, max(MAX_BITS, len(counts).bit_length())).tobytes()
    bounds = range_bounds(tokens, F.col("key"), F.col("n_tokens"), file_ids)

    def write(batches: Batches) -> Batches:
        file = shard = None
        for batch in batches:
            for row in batch.to_pylist():
                if row["shard"] != shard:
                    if file:
                        yield file.close()
                    shard = row["shard"]
                    file = _IdFile(root, shard, lengths)
                file.add(row["key"], row["n_tokens"], row["codes"], row["lanes"])
        if file:
            yield file.close()

    coded = map_batches(
        tokens.withColumn("shard", range_of(F.col("key"), bounds)),
        _coded(lengths),
        "key long, shard int, n_tokens long, codes binary, lanes binary",
    )
    dealt = coded.repartitionById(len(bounds), "shard").sortWithinPartitions("shard", "key", "codes")
    return publish(map_batches(dealt, write, FILE_COLUMNS), root)


def read_file(root: str, name: str) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(keys, ids, bounds) of each block: row i has the ids from bounds[i] to bounds[i + 1]."""
    with opened(root, name) as file:
        size = file.size()
        file.seek(size - 16)
        tail = file.read(16)
        file.seek(0)
        head = file.read(16)
        if tail[8:] != _MAGIC or head[:8] != _MAGIC:
            raise ValueError(f"{name} is no file of ids")
        coder = Coder(np.frombuffer(zlib.decompress(file.read(int.from_bytes(head[8:], "little"))), np.uint8))
        at = int.from_bytes(tail[:8], "little")
        file.seek(at)
        index = json.loads(zlib.decompress(file.read(size - 16 - at)))
        for at, n_codes, n_lanes, first, last in index["blocks"]:
            file.seek(at)
            codes, lanes = file.read(n_codes), np.frombuffer(file.read(n_lanes), "<u2")
            counts = np.array(index["counts"][first:last], np.int64)
            # A text's words follow from the bits of its stretches.
            per = (counts + LANE - 1) // LANE
            bits = np.concatenate(([0], np.cumsum(lanes.astype(np.int64))))[np.concatenate(([0], np.cumsum(per)))]
            words = np.concatenate(([0], np.cumsum((np.diff(bits) + 31) // 32)))
            ids = coder.decode(codes, words[:-1], counts, lanes)
            yield index["keys"][first:last], ids, np.concatenate(([0], np.cumsum(counts)))


def read_ids(files: DataFrame, root: str, key: str = "doc_id") -> DataFrame:
    """(key, start, ids) of every row in the files of a manifest."""
    schema = pa.schema([("key", pa.int64()), ("start", pa.int64()), ("ids", pa.list_(pa.int64()))])

    def lists(keys, start, ids, bounds):
        return record_batch(
            schema, keys, start + bounds[:-1], pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int64()))
        )

    return _read(files, root, lists, "key long, start long, ids array<long>").withColumnRenamed("key", key)


def _read(files: DataFrame, root: str, rows: Callable, schema: str) -> DataFrame:
    before = starts(files)

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for file in batch.to_pylist():
                start = before[file["shard"], file["number"]]
                for keys, ids, bounds in read_file(root, file["name"]):
                    yield rows(keys, start, ids, bounds)
                    start += int(bounds[-1])

    return map_batches(one_file_per_task(files), run, schema)


def op1_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    stage = fresh_path(spark, "token-ids")
    tokens = tokenised(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), "doc_id", "text")
    tokens.write.option("compression", "zstd").parquet(f"{stage}/tokens")
    tokens = spark.read.schema(tokens.schema).parquet(f"{stage}/tokens")
    files = write_ids(tokens, f"{stage}/files")
    schema = pa.schema(
        [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    )

    def digests(keys, start, ids, bounds):
        data, at = ids.astype("<u4").tobytes(), (4 * bounds).tolist()
        crcs = [zlib.crc32(data[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
        return record_batch(schema, keys, start + bounds[:-1], np.diff(bounds), crcs)

    return _read(files, f"{stage}/files", digests, "doc_id long, start long, n_tokens long, ids_crc32 long")
