"""A bounded filter of integer keys, by which rows that cannot meet any of them are kept out of a shuffle."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 64-bit words of a filter, at most (8 MB).
FILTER_WORDS = 1 << 20

KeyFilter = tuple[np.ndarray, int]


def _hash(key: Column) -> Column:
    return F.xxhash64(key.cast("long"))


def key_filter(keys: DataFrame, key: str, most: int = FILTER_WORDS) -> KeyFilter:
    """Has a bit for each of the keys: false hits, but no misses."""
    words = min(most, 1 << max(6, (keys.count() // 4).bit_length()))
    bit = F.expr("shiftleft(1L, CAST(pmod(shiftright(hash, 32), 64) AS INT))")
    rows = keys.select(_hash(F.col(key)).alias("hash")).select(F.pmod("hash", F.lit(words)).alias("word"), bit.alias("bit"))
    found = rows.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    packed = np.zeros(words, np.int64)
    packed[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return packed, words


def hashed(df: DataFrame, key: str) -> DataFrame:
    """With the column `hash` that `may_hold` takes."""
    return df.withColumn("hash", _hash(F.col(key)))


def may_hold(known: KeyFilter, hashes: pa.Array) -> np.ndarray:
    packed, words = known
    found = hashes.to_numpy()
    return packed[found % words] >> ((found >> 32) % 64) & 1 > 0
