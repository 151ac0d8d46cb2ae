"""Files that tasks write themselves, committed through temporary names and a manifest.

A task writes each file under a name of its own and reports it in a row. Spark
keeps the rows of the attempt that counts, so a lost or repeated task leaves
nothing but an unreported temporary file. Publishing renames what was reported
and then writes the manifest; readers look at the manifest only.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from tracewell.llm.batches import Batches, map_batches
from tracewell.sources.workspace import exists

#: What a task reports of a file; `number` counts the files of a shard.
FILE_COLUMNS = (
    "shard int, number int, temporary string, name string, bytes long, rows long, units long, "
    "first_key long, last_key long"
)
FILES = pa.schema(
    [
        ("shard", pa.int32()),
        ("number", pa.int32()),
        ("temporary", pa.string()),
        ("name", pa.string()),
        *[(name, pa.int64()) for name in ("bytes", "rows", "units", "first_key", "last_key")],
    ]
)


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """Any store that pyarrow knows; a plain path is a local or mounted folder."""
    if uri.startswith("/"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


class ShardFile:
    """A file being written, counted in bytes, rows and units."""

    def __init__(self, root: str, shard: int, number: int, ending: str):
        self.shard, self.number = shard, number
        self.name = f"shard-{shard:05d}-{number:05d}.{ending}"
        self.temporary = f"temporary/{self.name}.{uuid.uuid4().hex}"
        store, path = file_system(root)
        store.create_dir(f"{path}/temporary", recursive=True)
        self.stream = store.open_output_stream(f"{path}/{self.temporary}", compression=None)
        self.bytes = self.rows = self.units = 0
        self.first_key = self.last_key = None

    def write(self, data: bytes) -> None:
        self.stream.write(data)
        self.bytes += len(data)

    def count(self, key: int | None, units: int) -> None:
        self.first_key = key if not self.rows else self.first_key
        self.last_key = key
        self.rows, self.units = self.rows + 1, self.units + units

    def close(self) -> pa.RecordBatch:
        self.stream.close()
        return pa.RecordBatch.from_pylist([{f.name: getattr(self, f.name) for f in FILES}], FILES)


@contextmanager
def opened(root: str, name: str):
    store, path = file_system(root)
    with store.open_input_file(f"{path}/{name}") as file:
        yield file


def publish(written: DataFrame, root: str) -> DataFrame:
    """Run the writing job, give its files their names, and return the manifest.

    A root that has a manifest is refused: its files would be replaced one by one.
    """
    spark = written.sparkSession
    if exists(spark, f"{root}/manifest"):
        raise ValueError(f"{root} has been written before")
    # A writing job that was cut off may have left these.
    written.write.mode("overwrite").parquet(f"{root}/reported")
    reported = spark.read.schema(FILE_COLUMNS).parquet(f"{root}/reported")

    def rename(batches: Batches) -> Batches:
        store, path = file_system(root)
        for batch in batches:
            for row in batch.to_pylist():
                source, target = f"{path}/{row['temporary']}", f"{path}/{row['name']}"
                # An earlier attempt of this task may have done it already.
                if store.get_file_info(source).type != fs.FileType.NotFound:
                    store.move(source, target)
                size = store.get_file_info(target).size
                if size != row["bytes"]:
                    raise OSError(f"{row['name']} has {size} bytes instead of {row['bytes']}")
            yield batch

    map_batches(reported, rename, FILE_COLUMNS).write.parquet(f"{root}/manifest")
    # What is left under temporary names was written by attempts that do not count.
    store, path = file_system(root)
    if store.get_file_info(f"{path}/temporary").type != fs.FileType.NotFound:
        store.delete_dir(f"{path}/temporary")
    return manifest(spark, root)


def manifest(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(FILE_COLUMNS).parquet(f"{root}/manifest")


def starts(files: DataFrame) -> dict[tuple[int, int], int]:
    """Units in all files before each: one number per file comes to the driver."""
    total, found = 0, {}
    rows = files.select("shard", "number", "units").orderBy("shard", "number").toArrow().to_pylist()
    for row in rows:
        found[row["shard"], row["number"]] = total
        total += row["units"]
    return found


def one_file_per_task(files: DataFrame) -> DataFrame:
    """Rows of the manifest dealt out so that tasks read few files each."""
    return files.repartition(max(1, files.count()), "shard", "number")
