"""Benchmark passages in documents, found by spaced seeds.

A seed is the hash of the words under a mask; words under its gaps may differ. The
masks are fixed and chosen so that any 13 to 25 words of which at least four of five
are equal agree under one of them; longer stretches hold such a part, as one of two
halves has no lower share of equal words. Every match so has a seed. Seeds of the benchmark are joined with those of every
document inside the tasks that read the documents: the benchmark goes out in blocks
of at most `BLOCK_WORDS` words, each block a broadcast of bounded size and one pass
over the documents. Around each hit, document and item are laid along each other
and the longest stretch with at least four of five words equal is measured. A match
has a stretch of `MIN_WORDS` words.

Words are runs of ASCII letters and digits and of other characters than ASCII, in
lower case. An item of 5 to 12 words matches only where all of it occurs word
for word; one of fewer words cannot be told from chance and matches nothing. Null
and empty texts match nothing; a null key stays null; repeated rows match alike;
without documents or items there are no rows. Other columns are not looked at, or
kept as they are, whatever their names. Words are compared by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.batches import Batches, documents, keyed_texts, map_batches, record_batch, slices
from tracewell.llm.chunk_cache import HashTable
from tracewell.llm.words import Splitter, Words, mix, odd_numbers

MASKS = ("11110001011", "11011111", "101111011", "1110111", "11000100000111")
MIN_WORDS = 13
#: Items of fewer words than MIN_WORDS are looked up by so many at their beginning.
SHORT_SEED = 5
#: A mismatch costs so many matches: four of five words have to agree.
MISMATCH = 4
#: 16 MB of hashes, with the seeds some 100 MB in a worker.
BLOCK_WORDS = 1 << 20

_SEPARATORS = bytes(b for b in range(128) if not chr(b).isalnum())
_MATCHES = "key long, item_id long, doc_start long, item_start long, n_words long, n_equal long"


def _words(texts: pa.Array) -> Words:
    return Splitter(_SEPARATORS)(pc.utf8_lower(texts.cast(pa.string())))


def seeds(hashes: np.ndarray, mask: str, seed: int) -> np.ndarray:
    """Hash of the words under the mask, from each word on that has enough words after it."""
    n = len(hashes) - len(mask) + 1
    found = np.zeros(max(n, 0), np.uint64)
    weights = odd_numbers(len(mask), seed)
    for i, kept in enumerate(mask):
        if kept == "1" and n > 0:
            found += hashes[i : i + n] * weights[i]
    return mix(found)


class Index:
    """Words and seeds of some benchmark items."""

    def __init__(self, ids: list[int | None], texts: list[str | None]):
        words = _words(pa.array(texts, pa.string()))
        self.ids, self.hashes, self.bounds = ids, words.hashes, words.bounds
        owner = np.repeat(np.arange(len(ids)), words.counts)
        place = np.arange(len(owner)) - self.bounds[owner]
        rest = words.counts[owner] - place
        short = words.counts[owner] < MIN_WORDS
        self.masks, parts = [*MASKS, "1" * SHORT_SEED], []
        for number, mask in enumerate(self.masks):
            found = seeds(words.hashes, mask, number)
            at = np.arange(len(found))
            if number < len(MASKS):
                fits = (rest[at] >= len(mask)) & ~short[at]
            else:
                fits = (rest[at] >= len(mask)) & short[at] & (place[at] == 0)
            at = at[fits]
            parts.append(self._sorted(found[at], owner[at], place[at]))
        self.parts = parts

    @staticmethod
    def _sorted(hashes: np.ndarray, owner: np.ndarray, place: np.ndarray):
        order = np.argsort(hashes, kind="stable")
        known, first, counts = np.unique(hashes[order], return_index=True, return_counts=True)
        table = HashTable(max(4, int(4 * len(known)).bit_length()))
        table.add(known, np.arange(len(known), dtype=np.int32))
        return table, first, counts, owner[order], place[order]

    def item(self, i: int) -> np.ndarray:
        return self.hashes[self.bounds[i] : self.bounds[i + 1]]

    def hits(self, hashes: np.ndarray) -> np.ndarray:
        """Distinct (place in the documents less place in the item, item) of all seeds they share."""
        found = []
        for number, (mask, (table, first, counts, owner, place)) in enumerate(zip(self.masks, self.parts, strict=True)):
            value = table.find(seeds(hashes, mask, number))
            at = np.flatnonzero(value >= 0)
            n = counts[value[at]]
            entry = np.repeat(first[value[at]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            found.append(np.stack((np.repeat(at, n) - place[entry], owner[entry], np.repeat(at, n))))
        hits = np.concatenate(found, axis=1)
        # A hit's own place tells which document it is in.
        return np.unique(hits, axis=1)


def longest_stretch(equal: np.ndarray) -> tuple[int, int]:
    """The longest stretch in which at least four of five words are equal, with equal ends; the first of several."""
    sums = np.concatenate(([0], np.cumsum(np.where(equal, 1, -MISMATCH))))
    # The first place that begins with an equal word and whose sum is not above the one at the end.
    least = np.minimum.accumulate(np.where(np.append(equal, False), sums, len(sums)))
    begin = np.searchsorted(-least, -sums, "left")
    ends = np.append(False, equal)
    lengths = np.where(ends, np.arange(len(sums)) - begin, 0)
    end = int(np.argmax(lengths))
    return (int(begin[end]), end) if lengths[end] > 0 else (0, 0)


def matches_in(index: Index, hashes: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int, int, int, int]]:
    """(text, item, place in text, place in item, words, equal words): the best stretch of each text and item."""
    hits = index.hits(hashes)
    text = np.searchsorted(bounds, hits[2], "right") - 1
    lines = np.unique(np.stack((text, hits[1], hits[0])), axis=1)
    best: dict[tuple[int, int], tuple[int, int, int, int]] = {}
    for t, i, shift in lines.T.tolist():
        item = index.item(i)
        start = max(int(bounds[t]), shift)
        end = min(int(bounds[t + 1]), shift + len(item))
        equal = hashes[start:end] == item[start - shift : end - shift]
        a, b = longest_stretch(equal)
        n = int(equal[a:b].sum())
        if b - a >= MIN_WORDS or (len(item) < MIN_WORDS and n == len(item)):
            found = (n, -(start + a - int(bounds[t])), -(start + a - shift), b - a)
            best[t, i] = max(best.get((t, i), found), found)
    return [(t, i, -at, -place, size, n) for (t, i), (n, at, place, size) in sorted(best.items())]


def benchmark_blocks(benchmark: DataFrame, item: str, text: str, block_words: int):
    """The items, a bounded number of words at a time."""
    rows = benchmark.select(F.col(item).cast("long").alias("item"), F.col(text).cast("string").alias("text"))
    # At most one word in two bytes.
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // (2 * block_words)))
    for number in range(blocks):
        block = rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == number).toArrow()
        yield block.column("item").to_pylist(), block.column("text").to_pylist()


def find_matches(
    df: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """(key, item_id, doc_start, item_start, n_words, n_equal): a row per document and item that overlap."""
    texts = keyed_texts(df, key, text)
    schema = pa.schema([(name.split()[0], pa.int64()) for name in _MATCHES.split(", ")])
    found = None
    for block in benchmark_blocks(benchmark, item, item_text, block_words):
        shared = df.sparkSession.sparkContext.broadcast(block)

        def match(batches: Batches, shared=shared) -> Batches:
            index = Index(*shared.value)
            for batch in slices(batches):
                words = _words(batch.column("text"))
                rows = matches_in(index, words.hashes, words.bounds)
                keys = batch.column("key").to_pylist()
                columns = [[keys[r[0]] for r in rows], [index.ids[r[1]] for r in rows]]
                yield record_batch(schema, *columns, *[[r[n] for r in rows] for n in range(2, 6)])

        part = map_batches(texts, match, _MATCHES)
        found = part if found is None else found.unionByName(part)
    return found.withColumnRenamed("key", key)


def drop_contaminated(
    df: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """The rows whose text overlaps no item, as they are."""
    column = df.columns.index(text)
    for block in benchmark_blocks(benchmark, item, item_text, block_words):
        shared = df.sparkSession.sparkContext.broadcast(block)

        def keep(batches: Batches, shared=shared) -> Batches:
            index = Index(*shared.value)
            for batch in slices(batches, column):
                words = _words(batch.column(column))
                clean = np.ones(batch.num_rows, bool)
                clean[[row[0] for row in matches_in(index, words.hashes, words.bounds)]] = False
                yield batch.filter(pa.array(clean))

        df = df.mapInArrow(keep, df.schema)
    return df


def op2_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_matches(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
