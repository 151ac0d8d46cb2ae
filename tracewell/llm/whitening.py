r"""Whitening of embedding vectors by exact integer statistics.

An entry c becomes the integer x = floor(64 c) + 1000000. Statistics are over the fit
list, each distinct x vector once. Tasks shift each dimension by its least value and pack
its bit planes across rows into 64-bit words; the AND of two planes has as many bits set
as rows have both, so popcounts weighted by powers of two are exact cross-products. They
are added up and centred as integers, and only the covariance itself, each entry rounded
once, goes to the eigenvalue solver. Vectors are then projected on the first components
and divided by the roots of their eigenvalues.

A vector that is null, or holds null or non-finite entries, is left out; so is one whose
length is not that of most vectors of the fit list (the smaller one of two equally
frequent). Entries beyond +-2**56 count as that. Null keys, repeated keys and repeated
rows are rows each. Components whose eigenvalue is not above the rounding error of the
greatest have no direction and are left out, so equal vectors give no rows, as does an
empty table. `deviation` is null where it has more than 38 digits. Other columns are not
looked at.

One number for each dimension, and one for each pair of them, comes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.batches import Batches, map_batches, record_batch, slices
from tracewell.sources.workspace import materialise

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
#: Entries taken at a time, and bytes of bit planes.
ENTRIES, PLANE_BYTES = 1 << 20, 1 << 24
#: Weighted counts are added up for so many powers of two at a time, so that they fit 64 bits.
POWERS = 16
_FARTHEST = float(1 << 62)

_PACKED = pa.schema([("key", pa.int64()), ("packed", pa.binary())])
_RANGES = pa.schema([("dim", pa.int32()), ("low", pa.int64()), ("high", pa.int64())])
_PRODUCTS = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("limb", pa.int32()), ("total", pa.int64())])
_MOMENTS = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("total", pa.float64())])
_WHITENED = pa.schema(
    [
        ("key", pa.int64()),
        ("component", pa.int32()),
        ("deviation", pa.decimal128(38, 0)),
        ("whitened", pa.float64()),
    ]
)


# Vectors


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, floor(64 c)) of the usable vectors of a batch, one matrix for each length."""
    lists = batch.column("vector")
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
    values = lists.flatten().to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    usable = lengths > 0
    usable[owner[~np.isfinite(values)]] = False
    begins = np.cumsum(lengths) - lengths
    for length in np.unique(lengths[usable]):
        rows = np.flatnonzero(usable & (lengths == length))
        entries = values[begins[rows][:, None] + np.arange(length)]
        yield rows, np.floor(np.clip(SCALE * entries, -_FARTHEST, _FARTHEST)).astype(np.int64)


def _parts(batches: Batches) -> Batches:
    """The same rows, few enough at a time."""
    for batch in batches:
        most = pc.max(pc.list_value_length(batch.column("vector"))).as_py() or 1
        step = max(1, ENTRIES // most)
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)


def _pack(scaled: np.ndarray) -> list[bytes]:
    """Each vector in the fewest bytes per entry, so that equal ones are equal; that number comes first."""
    reach = np.maximum(scaled.max(axis=1), ~scaled.min(axis=1))
    found = [b""] * len(scaled)
    width = np.select([reach < 1 << 7, reach < 1 << 15, reach < 1 << 31], [1, 2, 4], 8)
    for n in np.unique(width):
        at = np.flatnonzero(width == n)
        narrow = scaled[at].astype(f"<i{n}")
        for i, row in zip(at.tolist(), narrow, strict=True):
            found[i] = bytes([n]) + row.tobytes()
    return found


def _length(packed):
    """Number of entries of a packed vector, as a Column."""
    return F.floor((F.length(packed) - 1) / F.conv(F.hex(F.substring(packed, 1, 1)), 16, 10).cast("int")).cast("int")


def _unpacked(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    out = np.empty((batch.num_rows, dims), np.int64)
    for i, packed in enumerate(batch.column("packed").to_pylist()):
        out[i] = np.frombuffer(packed, f"<i{packed[0]}", dims, 1)
    return out


def vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Only the key and the vector, under names that no other column can clash with."""
    return df.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("vector"))


def fit_list(rows: DataFrame) -> DataFrame:
    """(packed, length): each distinct vector once. Copies are put together within tasks first."""

    def run(batches: Batches) -> Batches:
        for batch in _parts(batches):
            keys = batch.column("key")
            for at, scaled in _matrices(batch):
                yield record_batch(_PACKED, keys.take(pa.array(at)), pa.array(_pack(scaled), pa.binary()))

    packed = map_batches(rows, run, "key long, packed binary").groupBy("packed").agg(F.min("key").alias("key"))
    return packed.select("packed", _length("packed").alias("length"))


# Statistics


@dataclass(frozen=True)
class Statistics:
    """Exact sums over the fit list, of entries less the least of their dimension."""

    n: int
    low: list[int]
    high: list[int]
    sums: list[int]
    products: dict[tuple[int, int], int]

    @property
    def dims(self) -> int:
        return len(self.low)

    def covariance(self) -> np.ndarray:
        found = np.zeros((self.dims, self.dims))
        for (i, j), product in self.products.items():
            centred = self.n * product - self.sums[i] * self.sums[j]
            # The quotient of integers is rounded once.
            found[i, j] = found[j, i] = centred / (self.n * self.n)
        return found


def _ranges(fit: DataFrame, dims: int) -> tuple[list[int], list[int]]:
    def run(batches: Batches) -> Batches:
        low, high = np.full(dims, np.iinfo(np.int64).max), np.full(dims, np.iinfo(np.int64).min)
        for batch in slices(batches, "packed"):
            found = _unpacked(batch, dims)
            low, high = np.minimum(low, found.min(axis=0)), np.maximum(high, found.max(axis=0))
        if (low <= high).all():
            yield record_batch(_RANGES, np.arange(dims), low, high)

    rows = map_batches(fit.select("packed"), run, "dim int, low long, high long")
    found = rows.groupBy("dim").agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("dim").toArrow()
    return found.column("low").to_pylist(), found.column("high").to_pylist()


def bit_planes(shifted: np.ndarray, bits: list[int]) -> np.ndarray:
    """A row of 64-bit words for each bit of each dimension; rows of `shifted` are bits of the words."""
    words = -(-len(shifted) // 64)
    planes = np.zeros((sum(bits), 8 * words), np.uint8)
    at = 0
    for dim, n in enumerate(bits):
        for power in range(n):
            one = ((shifted[:, dim] >> np.uint64(power)) & np.uint64(1)).astype(np.uint8)
            packed = np.packbits(one)
            planes[at, : len(packed)] = packed
            at += 1
    return planes.view(np.uint64)


def _products(low: list[int], bits: list[int]):
    """Weighted popcounts of the planes of each pair of dimensions; j is -1 for the sums of i."""
    dims = len(low)
    first = np.concatenate(([0], np.cumsum(bits))).astype(np.int64)
    dim_of = np.repeat(np.arange(dims), bits)
    power_of = np.arange(first[-1]) - first[dim_of]
    block = max(64, PLANE_BYTES * 8 // max(1, int(first[-1])))
    limbs = 1 + 2 * max(bits, default=0) // POWERS

    def run(batches: Batches) -> Batches:
        least = np.array(low, np.int64)
        totals = np.zeros((limbs, dims, dims), np.int64)
        sums = np.zeros((limbs, dims), np.int64)

        def count(rows: np.ndarray) -> None:
            planes = bit_planes((rows - least).view(np.uint64), bits)
            ones = np.bitwise_count(planes).sum(axis=1, dtype=np.int64)
            np.add.at(sums, (power_of // POWERS, dim_of), ones << (power_of % POWERS))
            for p in range(len(planes)):
                i = dim_of[p]
                others = slice(first[i], None)
                both = np.bitwise_count(planes[others] & planes[p]).sum(axis=1, dtype=np.int64)
                power = power_of[others] + power_of[p]
                np.add.at(totals, (power // POWERS, i, dim_of[others]), both << (power % POWERS))

        held, rows = [], 0
        for batch in slices(batches, "packed"):
            held.append(_unpacked(batch, dims))
            rows += batch.num_rows
            if rows >= block or rows * dims >= ENTRIES:
                count(np.concatenate(held))
                held, rows = [], 0
        if held:
            count(np.concatenate(held))
        limb, i, j = np.nonzero(totals)
        yield record_batch(_PRODUCTS, i, j, limb, totals[limb, i, j])
        limb, i = np.nonzero(sums)
        yield record_batch(_PRODUCTS, i, np.full(len(i), -1), limb, sums[limb, i])

    return run


def statistics(fit: DataFrame, dims: int) -> Statistics:
    """Of the vectors (packed) of one length."""
    n = fit.count()
    low, high = _ranges(fit, dims)
    bits = [(b - a).bit_length() for a, b in zip(low, high, strict=True)]
    rows = map_batches(fit.select("packed"), _products(low, bits), "i int, j int, limb int, total long")
    found = rows.groupBy("i", "j", "limb").agg(F.sum("total").alias("total")).toArrow().to_pylist()
    sums = [0] * dims
    products = {(i, j): 0 for i in range(dims) for j in range(i, dims)}
    for row in found:
        total = row["total"] << POWERS * row["limb"]
        if row["j"] < 0:
            sums[row["i"]] += total
        else:
            products[row["i"], row["j"]] += total
    return Statistics(n, low, high, sums, products)


# Whitening


@dataclass(frozen=True)
class Whitening:
    statistics: Statistics
    #: A column for each component, divided by the root of its eigenvalue.
    projection: np.ndarray
    explained: list[float]

    @property
    def components(self) -> int:
        return len(self.explained)

    def deviations(self, scaled: np.ndarray) -> np.ndarray:
        """n x - S of each entry, in 64 bits where they suffice."""
        known = self.statistics
        shifted = (scaled - np.array(known.low, np.int64)).astype(np.uint64)
        # Vectors that were fitted lie between the least and the greatest entries.
        widest = max(b - a for a, b in zip(known.low, known.high, strict=True))
        if known.n * widest < 1 << 60:
            return known.n * shifted.astype(np.int64) - np.array(known.sums, np.int64)
        return known.n * shifted.astype(object) - np.array(known.sums, object)

    def whitened(self, deviations: np.ndarray) -> np.ndarray:
        return (deviations / self.statistics.n).astype(np.float64) @ self.projection


def squares(deviations: np.ndarray) -> list[int]:
    """Exact sum of the squares of each row."""
    if deviations.dtype == object:
        return (deviations * deviations).sum(axis=1).tolist()
    size = np.abs(deviations)
    limbs = [(size >> 24 * i) & 0xFFFFFF for i in range(3)]
    totals = [0] * len(deviations)
    for i in range(3):
        for j in range(i, 3):
            # Products of 24 bits leave room for the sum over as many dimensions as vectors have.
            part = (limbs[i] * limbs[j]).sum(axis=1)
            if part.any():
                weight = (1 if i == j else 2) << 24 * (i + j)
                totals = [total + weight * one for total, one in zip(totals, part.tolist(), strict=True)]
    return totals


def whitening(known: Statistics, components: int = COMPONENTS) -> Whitening:
    covariance = known.covariance()
    values, directions = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:components]
    floor = len(values) * np.finfo(float).eps * max(float(values.max()), 0.0)
    order = order[values[order] > floor]
    return Whitening(
        known, directions[:, order] / np.sqrt(values[order]), (values[order] / np.trace(covariance)).tolist()
    )


def identity_error(fit: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened fit list's covariance less the identity."""
    dims, k = model.statistics.dims, model.components

    def run(batches: Batches) -> Batches:
        total = np.zeros((k + 1, k))
        for batch in slices(batches, "packed"):
            found = model.whitened(model.deviations(_unpacked(batch, dims)))
            total[:k] += found.T @ found
            total[k] += found.sum(axis=0)
        i, j = np.indices(total.shape)
        yield record_batch(_MOMENTS, i.ravel(), j.ravel(), total.ravel())

    rows = map_batches(fit.select("packed"), run, "i int, j int, total double")
    total = np.zeros((k + 1, k))
    for row in rows.groupBy("i", "j").agg(F.sum("total").alias("total")).collect():
        total[row["i"], row["j"]] = row["total"] / model.statistics.n
    # The mean is what rounding leaves of zero.
    return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())


def fitted(rows: DataFrame, components: int = COMPONENTS) -> tuple[Whitening, float] | None:
    """The whitening of (key, vector) and its identity error; None if there is nothing to whiten."""
    fit = materialise(fit_list(rows), "fit")
    lengths = fit.groupBy("length").agg(F.count("*").alias("vectors"))
    commonest = lengths.orderBy(F.desc("vectors"), "length").first()
    if commonest is None:
        return None
    fit = fit.where(F.col("length") == commonest["length"])
    model = whitening(statistics(fit, commonest["length"]), components)
    return (model, identity_error(fit, model)) if model.components else None


def whiten(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS
) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error): a row for each vector and component."""
    rows = vectors(df, key, vector)
    schema = "key long, component int, deviation decimal(38,0), whitened double"
    found = fitted(rows, components)
    if found is None:
        made = rows.sparkSession.createDataFrame([], schema)
        model, n, error, explained = None, 0, 0.0, [0.0]
    else:
        model, error = found
        n, explained = model.statistics.n, model.explained

        def run(batches: Batches) -> Batches:
            k, dims = model.components, model.statistics.dims
            for batch in _parts(batches):
                for at, scaled in _matrices(batch):
                    if scaled.shape[1] != dims:
                        continue
                    deviations = model.deviations(scaled)
                    totals = [t if t < 10**38 else None for t in squares(deviations)]
                    decimals = pa.array([None if t is None else Decimal(t) for t in totals], pa.decimal128(38, 0))
                    places = pa.array(np.repeat(np.arange(len(at)), k))
                    yield record_batch(
                        _WHITENED,
                        batch.column("key").take(pa.array(at)).take(places),
                        np.tile(np.arange(1, k + 1), len(at)),
                        decimals.take(places),
                        model.whitened(deviations).ravel(),
                    )

        made = map_batches(rows, run, schema)
    shares = F.array(*map(F.lit, explained))
    return made.select(
        F.col("key").alias(key),
        "component",
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.element_at(shares, F.col("component")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )


def op12_bit_sliced_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.withColumn("deviation", F.col("deviation").try_cast("long"))
