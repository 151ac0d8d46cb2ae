"""Where intermediate and scratch output goes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
#: Of stored records: names have long prefixes in common, which this makes two thirds as large as Spark's default does.
COMPRESSION = "zstd"

_own_roots: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names in `spark.checkpoint.dir`.

    Only a local master, where driver and executors are one machine, gets a
    folder of its own when none is named.
    """
    root = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getConf().get(CHECKPOINT_DIR)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own_roots:
            _own_roots[app] = tempfile.mkdtemp(prefix="tracewell-")
        root = _own_roots[app]
    return root.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that no other run uses."""
    app = spark.sparkContext.applicationId
    return f"{shared_root(spark)}/tracewell/{app}/{label}-{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, path: str):
    """The store of a path, as the session's settings reach it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    store, at = _file_system(spark, path)
    return store.exists(at)


def make_dirs(spark: SparkSession, path: str) -> None:
    store, at = _file_system(spark, path)
    store.mkdirs(at)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none where it is not there."""
    store, at = _file_system(spark, path)
    return [status.getPath().getName() for status in store.listStatus(at)] if store.exists(at) else []


def read_text(spark: SparkSession, path: str) -> str:
    store, at = _file_system(spark, path)
    stream = store.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A new file; its folders are made."""
    store, at = _file_system(spark, path)
    stream = store.create(at, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def rename(spark: SparkSession, source: str, target: str) -> bool:
    store, at = _file_system(spark, source)
    return store.rename(at, spark._jvm.org.apache.hadoop.fs.Path(target))


def move(spark: SparkSession, source: str, target: str) -> None:
    """Rename a directory of one store; the target must not be there."""
    store, at = _file_system(spark, source)
    if not store.rename(at, spark._jvm.org.apache.hadoop.fs.Path(target)):
        raise OSError(f"cannot rename {source} to {target}")


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write `df` to the shared folder and go on from there.

    Cuts the plan like a checkpoint, and what it leaves is columnar and
    outlives the executors that wrote it.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialise_buckets(
    df: DataFrame, label: str, key: str, dealt: bool = False
) -> tuple[DataFrame, Callable[[], None]]:
    """As `materialise`, in buckets by a key, so that later joins on it leave the rows where they are.

    Buckets need a table's metadata; the second result drops them, not the files. Rows `dealt` by
    the key before, into as many tasks as a shuffle has, are not shuffled again.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    name = f"{label}_{path.rsplit('-', 1)[1]}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df if dealt else df.repartition(buckets, key)
    rows.write.bucketBy(buckets, key).option("path", path).saveAsTable(name)
    return spark.table(name), lambda: spark.sql(f"DROP TABLE IF EXISTS {name}")
