"""Token counts by a two-tier lookup on the map side.

A first pass over all texts finds frequent chunks: each task keeps a bounded
summary of its most frequent ones, and only those summaries are added up. Their
token counts go out as one compact table (a hash and a length per chunk, at most
`TABLE_CHUNKS` of them). The second pass takes the counts of frequent chunks from
that table and those of all others from the worker's cache, which asks the
tokenizer once per new chunk. No chunk of the second pass is ever shuffled, and
what the first pass finds decides speed only, never a count.

Null and empty texts have 0 bytes and 0 tokens; a null key stays null; repeated
rows give repeated rows; an empty table gives an empty one; further columns of
the input are not looked at. Chunks are told apart by 64-bit hashes (`words.py`).
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.batches import Batches, documents, keyed_texts, map_batches, record_batch, slices
from tracewell.llm.chunk_cache import ChunkCache, HashTable
from tracewell.llm.word_bpe import SPECIAL, chunks, word_bpe

#: Entries of the broadcast table: 12 bytes each, so at most 0.8 MB.
TABLE_CHUNKS = 1 << 16
#: Chunks that one task proposes for it, and the longest chunk proposed.
TASK_CHUNKS, CHUNK_BYTES = 1 << 13, 48
LIMIT = 2048

_SUMMARY = pa.schema([("chunk", pa.string()), ("n", pa.int64())])
_LENGTHS = pa.schema([("hash", pa.int64()), ("n_tokens", pa.int32())])
_COUNTS = pa.schema([("key", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])


def _frequent(batches: Batches) -> Batches:
    split = chunks()
    kept: dict[bytes, int] = {}
    for batch in slices(batches):
        words = split(batch.column("text"), SPECIAL)
        hashes, first, counts = np.unique(words.hashes, return_index=True, return_counts=True)
        short = words.ends[first] - words.starts[first] <= CHUNK_BYTES
        top = np.argsort(-counts * short, kind="stable")[: 2 * TASK_CHUNKS]
        top = top[short[top]]
        for s, e, n in zip(
            words.starts[first[top]].tolist(), words.ends[first[top]].tolist(), counts[top].tolist(), strict=True
        ):
            chunk = words.raw[s:e].tobytes().lower()
            kept[chunk] = kept.get(chunk, 0) + n
        if len(kept) > 4 * TASK_CHUNKS:
            kept = dict(sorted(kept.items(), key=lambda x: -x[1])[: 2 * TASK_CHUNKS])
    kept = {c: n for c, n in kept.items() if SPECIAL not in c}
    best = sorted(kept.items(), key=lambda x: -x[1])[:TASK_CHUNKS]
    yield record_batch(_SUMMARY, [c.decode() for c, _ in best], [n for _, n in best])


def frequent_chunks(texts: DataFrame, size: int = TABLE_CHUNKS) -> DataFrame:
    """At most `size` chunks that occur often in `texts(key, text)`."""
    summaries = map_batches(texts, _frequent, "chunk string, n long")
    totals = summaries.groupBy("chunk").agg(F.sum("n").alias("n"))
    return totals.orderBy(F.desc("n"), "chunk").limit(size)


def frequent_lengths(texts: DataFrame, path: str, size: int = TABLE_CHUNKS) -> tuple[bytes, bytes]:
    """Hashes and token counts of frequent chunks, as two packed arrays."""

    def lengths(batches: Batches) -> Batches:
        encode, split = word_bpe(path), chunks()
        for batch in batches:
            found = batch.column("chunk")
            yield record_batch(
                _LENGTHS,
                split(found).hashes.view(np.int64),
                [len(ids) for ids in encode([c.encode() for c in found.to_pylist()])],
            )

    found = map_batches(frequent_chunks(texts, size), lengths, "hash long, n_tokens int").toArrow()
    return (
        found.column("hash").to_numpy().astype(np.int64).tobytes(),
        found.column("n_tokens").to_numpy().astype(np.int32).tobytes(),
    )


@lru_cache(1)
def _first_tier(packed: tuple[bytes, bytes]) -> HashTable:
    table = HashTable(17)
    table.add(np.frombuffer(packed[0], np.uint64), np.frombuffer(packed[1], np.int32))
    return table


@lru_cache(2)
def _second_tier(path: str) -> ChunkCache:
    return ChunkCache(word_bpe(path))


def token_counts(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_tokens) of every text, as the tokenizer file at `path` counts."""
    texts = keyed_texts(df, key, text)
    spark = df.sparkSession
    packed = spark.sparkContext.broadcast(frequent_lengths(texts, path))

    def count(batches: Batches) -> Batches:
        split, frequent, cache = chunks(), _first_tier(packed.value), _second_tier(path)
        for batch in slices(batches):
            words = split(batch.column("text"), SPECIAL)
            sizes = frequent.find(words.hashes).astype(np.int64)
            rest = np.flatnonzero(sizes < 0)
            entries = cache.entries_of(words, rest)
            sizes[rest] = cache.sizes[entries]
            ends = np.concatenate(([0], np.cumsum(sizes)))
            yield record_batch(
                _COUNTS,
                batch.column("key"),
                np.diff(words.offsets),
                np.diff(ends[words.bounds]),
            )

    return map_batches(texts, count, "key long, n_bytes long, n_tokens long").withColumnRenamed("key", key)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counts = token_counts(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > LIMIT)
