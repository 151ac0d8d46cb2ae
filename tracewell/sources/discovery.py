"""Datasets below a storage root: what is there, how large, with which columns.

A crawl keeps its listing, so the next one knows which datasets changed and reads only
those again.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.sources.workspace import children, rename

SUFFIX = ".parquet"
SCHEME_AND_AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?"
COLUMN_SCHEMA = "dataset string, position int, column_name string, column_type string"


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """Data files below `root`; the listing only, no file content is read."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", f"*{SUFFIX}")
        .load(root)
    )
    return files.select("path", "length", "modificationTime")


def _below(root: str) -> Column:
    """First path component of a listed file below `root`: a directory or a file."""
    bare = F.regexp_replace("path", SCHEME_AND_AUTHORITY, "")
    base = re.sub(SCHEME_AND_AUTHORITY, "", root).rstrip("/")
    return F.substring_index(F.substring(bare, len(base) + 2, 2147483647), "/", 1)


def list_datasets(spark: SparkSession, root: str) -> DataFrame:
    """Files below `root` with the dataset that each belongs to."""
    first = _below(root)
    return list_files(spark, root).withColumns(
        {
            "dataset": F.regexp_replace(first, r"\.parquet$", ""),
            "location": F.concat(F.lit(f"{root.rstrip('/')}/"), first),
        }
    )


def discover(spark: SparkSession, root: str) -> DataFrame:
    """One row per dataset: a directory, or a single file, directly below `root`."""
    return (
        list_datasets(spark, root)
        .groupBy("dataset", "location")
        .agg(
            F.count(F.lit(1)).alias("files"),
            F.sum("length").alias("bytes"),
            F.max("modificationTime").alias("last_modified"),
        )
    )


def discover_columns(spark: SparkSession, root: str) -> DataFrame:
    """Columns of every dataset below `root`: those of all its files, then those of directory names.

    Spark merges the footers of each dataset in tasks, through the file systems of
    the session. Files whose types for a column cannot be merged are an error.
    """
    found = discover(spark, root).select("dataset", "location").orderBy("location").collect()
    return _columns_of(spark, [tuple(row) for row in found])


def _columns_of(spark: SparkSession, datasets: list[tuple[str, str]]) -> DataFrame:
    rows = []
    for dataset, location in datasets:
        fields = spark.read.option("mergeSchema", "true").parquet(location).schema.fields
        rows += [(dataset, i, field.name, field.dataType.simpleString()) for i, field in enumerate(fields)]
    return spark.createDataFrame(rows, COLUMN_SCHEMA)


LISTING_SCHEMA = "path string, length long, modificationTime timestamp, dataset string, location string"


@dataclass(frozen=True)
class Crawl:
    """What a crawl found, beside the one before it."""

    number: int
    #: (dataset, location) of those with a new, changed or removed file that are still there, and of those gone.
    changed: list[tuple[str, str]]
    removed: list[tuple[str, str]]
    #: Where listing and columns are kept.
    path: str

    def listing(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(LISTING_SCHEMA).parquet(f"{self.path}/listing")

    def columns(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(COLUMN_SCHEMA).parquet(f"{self.path}/columns")


def file_changes(before: DataFrame, now: DataFrame) -> DataFrame:
    """(path, dataset, location, change) of files that were added, changed or removed between two listings.

    A file has changed where its length or its time has.
    """
    old = before.select("path", F.struct("length", "modificationTime").alias("was"), "dataset", "location")
    new = now.select("path", F.struct("length", "modificationTime").alias("is"), "dataset", "location")
    joined = old.alias("old").join(new.alias("new"), "path", "full_outer")
    change = (
        F.when(F.col("was").isNull(), "added")
        .when(F.col("is").isNull(), "removed")
        .when(F.col("was") != F.col("is"), "changed")
    )
    return joined.select(
        "path",
        F.coalesce("new.dataset", "old.dataset").alias("dataset"),
        F.coalesce("new.location", "old.location").alias("location"),
        change.alias("change"),
    ).where("change IS NOT NULL")


def crawl(spark: SparkSession, root: str, store: str) -> Crawl:
    """List `root`, compare with the last crawl kept in `store`, and keep this one.

    Footers are read of changed datasets only; columns of the others are those of the crawl
    before. A crawl becomes the last one by one rename; if another one takes its number
    meanwhile, that one stands and this one is an error.
    """
    numbers = sorted(int(name) for name in children(spark, store) if name.isdigit())
    number, aside = (numbers[-1] if numbers else 0) + 1, f"{store}/_{uuid.uuid4().hex}"
    list_datasets(spark, root).select("path", "length", "modificationTime", "dataset", "location").write.parquet(
        f"{aside}/listing"
    )
    now = spark.read.schema(LISTING_SCHEMA).parquet(f"{aside}/listing")
    if numbers:
        last = Crawl(numbers[-1], [], [], f"{store}/{numbers[-1]:010d}")
        before = last.listing(spark)
    else:
        before = now.limit(0)
    changes = file_changes(before, now).select("dataset", "location").distinct()
    there = now.select("dataset", "location").distinct().withColumn("there", F.lit(True))
    rows = changes.join(there, ["dataset", "location"], "left").orderBy("location").collect()
    changed = [(row["dataset"], row["location"]) for row in rows if row["there"]]
    removed = [(row["dataset"], row["location"]) for row in rows if not row["there"]]
    columns = _columns_of(spark, changed)
    if numbers:
        touched = spark.createDataFrame([(row["dataset"],) for row in rows], "dataset string")
        columns = columns.unionByName(last.columns(spark).join(touched, "dataset", "left_anti"))
    columns.write.parquet(f"{aside}/columns")
    target = f"{store}/{number:010d}"
    rename(spark, aside, target)
    if aside.rsplit("/", 1)[1] in children(spark, target):
        raise RuntimeError(f"another crawl took number {number} of {store}")
    return Crawl(number, changed, removed, target)


def dataset_location(spark: SparkSession, root: str, dataset: str) -> str:
    """Where a discovered dataset lies."""
    found = discover(spark, root).where(F.col("dataset") == dataset)
    # A directory and a file may share a name: the same one is taken each time.
    row = found.select("location").orderBy("location").first()
    if row is None:
        raise LookupError(f"no dataset {dataset} below {root}")
    return row.location
