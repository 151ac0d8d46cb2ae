"""Small helpers for operators that work on Arrow batches inside tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text taken at a time, so that a batch of long texts stays small in numpy.
SLICE_BYTES = 1 << 20

Batches = Iterator[pa.RecordBatch]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def keyed_texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """Only the key and the text, under names that no other column can clash with."""
    return df.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))


def slices(batches: Batches, column: str | int = "text", limit: int = SLICE_BYTES) -> Batches:
    """The same rows in batches of at most `limit` bytes of text, or of one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = size = 0
        for i, n in enumerate(sizes):
            if size and size + n > limit:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        if start < len(sizes):
            yield batch.slice(start)


def record_batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    arrays = [
        c if isinstance(c, pa.Array) else pa.array(c, field.type)
        for c, field in zip(columns, schema, strict=True)
    ]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def map_batches(df: DataFrame, function: Callable[[Batches], Batches], schema: str) -> DataFrame:
    return df.mapInArrow(function, schema)
