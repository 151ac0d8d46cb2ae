"""Ranges of a key with near equal weight, the same for the same rows however they are dealt."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.batches import Batches, map_batches, record_batch

#: Bins of the first histogram, and parts into which a heavy bin is split.
BINS, PARTS = 4096, 64
_BINS = pa.schema([("bin", pa.int32()), ("weight", pa.int64())])
_LEAST = -(1 << 63)


def _histogram(rows: DataFrame, edges: np.ndarray) -> np.ndarray:
    """Weight of the keys from each edge to the next."""

    def count(batches: Batches) -> Batches:
        totals = np.zeros(len(edges), np.int64)
        for batch in batches:
            bins = np.searchsorted(edges, batch.column("key").to_numpy(), "right") - 1
            np.add.at(totals, bins, batch.column("weight").to_numpy())
        used = np.flatnonzero(totals)
        yield record_batch(_BINS, used, totals[used])

    found = map_batches(rows, count, "bin int, weight long").groupBy("bin").agg(F.sum("weight").alias("w")).toArrow()
    weights = np.zeros(len(edges), np.int64)
    weights[found.column("bin").to_numpy()] = found.column("w").to_numpy()
    return weights


def range_bounds(df: DataFrame, key: Column, weight: Column, target: int, most: int | None = None) -> list[int]:
    """First keys of ranges whose weights are near `target`; the first range is open below.

    With `most`, ranges grow with the rows so that there are about so many at most.

    Equal keys stay in one range, so one of more than the target makes a larger
    range. Null keys belong to the first. Histograms come to the driver, with a
    few bins per range.
    """
    rows = df.select(F.coalesce(key.cast("long"), F.lit(_LEAST)).alias("key"), weight.cast("long").alias("weight"))
    known = rows.where(F.col("key") > _LEAST).agg(F.min("key"), F.max("key"), F.sum("weight")).first()
    if known[0] is None:
        return [_LEAST]
    low, high = known[0], known[1]
    target = max(target, known[2] // most) if most else target
    step = max(1, -(-(high - low + 1) // BINS))
    edges = np.array([_LEAST, *range(low, high + 1, step)], object)
    while True:
        weights = _histogram(rows, edges.astype(np.int64))
        ends = [*edges[1:], high + 1]
        more = []
        for first, end, w in zip(edges, ends, weights, strict=True):
            if first > _LEAST and w * 8 > target and end - first > 1:
                more += range(first, end, max(1, -(-(end - first) // PARTS)))[1:]
        if not more:
            break
        edges = np.array(sorted({*edges, *more}), object)
    bounds, filled = [_LEAST], 0
    for first, w in zip(edges.tolist(), weights.tolist(), strict=True):
        if filled and filled + w > target and first > _LEAST:
            bounds.append(first)
            filled = 0
        filled += w
    return bounds


def range_of(key: Column, bounds: list[int]) -> Column:
    """Number of the range that a key is in."""
    edges = np.array(bounds, np.int64)

    @F.arrow_udf("int")
    def number(keys: pa.Array) -> pa.Array:
        found = np.searchsorted(edges, keys.to_numpy(zero_copy_only=False), "right") - 1
        return pa.array(found, pa.int32())

    return number(F.coalesce(key.cast("long"), F.lit(_LEAST)))
