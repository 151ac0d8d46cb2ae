"""Answers about edges that are kept up to date as jobs record.

Of each distinct link of a process (source, target, level) one row is stored: the
first of them, by start time and then by event name, and how many there are. First and
number are mergeable, so a refresh aggregates only the links of commits since the last
one and merges them. The rows have the shape of links, so operators on distinct edges
take them as they are; those that count links add up `links` here.

A purge takes links away, which a least value cannot follow: the processes in the files
it removed are made anew from the links that are left in their locations. A compaction
changes files but no records, and is passed over; what it replaced is still read where
it was new since the last refresh.

States lie below the log in folders named by the number of their commit, put in place
by one rename like commits; jobs that refresh at the same time write the same. Earlier
states are left where they are. A state has a folder of rows per area, the location that
the names of its processes have in them, and goes on with the folders of areas that no
change since the last refresh belongs to.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell import fixed_values as V
from tracewell.functions import process_of
from tracewell.operators.links import collapsed
from tracewell.sources import commits
from tracewell.sources.commits import DataFile
from tracewell.sources.log import LINK_SCHEMA, read_files
from tracewell.sources.workspace import COMPRESSION, children, exists, make_dirs, read_text, rename, write_text

STATE_SCHEMA = f"{LINK_SCHEMA}, links long"
#: The folder for rows whose process names no location.
NO_AREA = "__HIVE_DEFAULT_PARTITION__"


@dataclass(frozen=True)
class Standing:
    """The distinct links of a log as of a commit, and the files of the log that were read for it."""

    number: int
    links: DataFrame
    read: tuple[str, ...] = ()


def distinct_links(links: DataFrame) -> DataFrame:
    """One row per process and distinct link of it: the first, and how many `links` it stands for."""
    return _merged(links, F.count(F.lit(1)))


def _merged(links: DataFrame, number: Column, logged: DataFrame | None = None) -> DataFrame:
    first = F.min(F.struct("start_time", "event", "link_pos", "location")).alias("first")
    grouped = collapsed(links, ["source", "target", "level"], first, number.alias("links"), by_process=True, logged=logged)
    return grouped.select(
        "first.event", "first.start_time", "first.link_pos", "source", "target", "level", "first.location", "links"
    )


def refresh(spark: SparkSession, root: str) -> Standing:
    """The distinct links of the log at `root` as of its latest commit; what was not there is stored."""
    found = commits.state(spark, root)
    folder = f"{root}/standing"
    numbers = sorted(int(name) for name in children(spark, folder) if name.isdigit())
    last = max((number for number in numbers if number <= found.number), default=0)
    if last and last == found.number:
        return Standing(last, _stored(spark, _parts(spark, folder, last).values()))
    if last:
        links, kept, read = _brought_on(spark, root, found, last)
    else:
        files = found.of("links")
        links, kept, read = distinct_links(read_files(spark, found, "links", files)), {}, [file.path for file in files]
    data = f"{folder}/data-{uuid.uuid4().hex}"
    parts = kept if links is None else kept | _written(links, data)
    target, aside = f"{folder}/{found.number:020d}", f"{folder}/_{uuid.uuid4().hex}"
    if not exists(spark, target):
        write_text(spark, f"{aside}/state.json", json.dumps({"areas": parts}))
        make_dirs(spark, folder)
        rename(spark, aside, target)
    return Standing(found.number, _stored(spark, _parts(spark, folder, found.number).values()), tuple(sorted(read)))


def _area() -> Column:
    """The location in the name of a process: rows of a process are in one area, so links never meet across areas."""
    name = F.col("event")
    location = F.regexp_extract(name, "^[^/]*/[^/]*/locations/([^/]+)/processes/", 1)
    return F.when(location != "", location)


def _areas(rows: DataFrame) -> set[str]:
    """Folder names of the areas that rows belong to."""
    return {NO_AREA if row["area"] is None else row["area"] for row in rows.select(_area().alias("area")).distinct().collect()}


def _written(links: DataFrame, data: str) -> dict[str, str]:
    """The folder of each area, written at once; sorted by name, rows are smaller there and in later shuffles."""
    ordered = links.withColumn("area", _area()).sortWithinPartitions("area", "event")
    ordered.write.partitionBy("area").parquet(data, compression=COMPRESSION)
    names = [name for name in children(links.sparkSession, data) if name.startswith("area=")]
    return {unquote(name.removeprefix("area=")): f"{data}/{name}" for name in names}


def _parts(spark: SparkSession, folder: str, number: int) -> dict[str, str]:
    """The folder of each area of a state; an older state has one of all."""
    found = json.loads(read_text(spark, f"{folder}/{number:020d}/state.json"))
    return found["areas"] if "areas" in found else {"": found["data"]}


def _stored(spark: SparkSession, folders: Iterable[str]) -> DataFrame:
    rows = spark.read.schema(STATE_SCHEMA)
    return rows.parquet(*folders) if (folders := list(folders)) else spark.createDataFrame([], STATE_SCHEMA)


def _brought_on(
    spark: SparkSession, root: str, found: commits.State, last: int
) -> tuple[DataFrame | None, dict[str, str], list[str]]:
    """What later commits make of the state of commit `last`: new rows, areas that stay, and the files read."""
    before = commits.state(spark, root, last)
    since = commits.between(spark, root, last, found.number)
    known = before.files | {file.path: file for commit in since for file in commit.add}
    changes = [commit for commit in since if not commit.same]
    added = [file for commit in changes for file in commit.add if file.kind == "links"]
    removed = [known[path] for commit in changes for path in commit.remove if known[path].kind == "links"]

    parts = _parts(spark, f"{root}/standing", last)
    if not added and not removed:
        return None, parts, []
    changed = read_files(spark, found, "links", [*added, *removed])
    touched = {"", *_areas(changed)}
    kept = {area: path for area, path in parts.items() if area not in touched}
    rows = _stored(spark, [path for area, path in parts.items() if area in touched])
    merged = rows
    if added:
        # A link that was added stands for itself, so stored and added ones are merged at once.
        new = read_files(spark, found, "links", added).select(*rows.columns[:-1], F.lit(1).cast("long").alias("links"))
        merged = rows.unionByName(new)
    if not removed:
        return _merged(merged, F.sum("links")), kept, [file.path for file in added]

    gone = read_files(spark, found, "links", removed).select(process_of(F.col("event")).alias("gone")).distinct()
    touched_process = process_of(F.col("event")).eqNullSafe(F.col("gone"))
    locations = {file.location for file in removed}
    left: list[DataFile] = [file for file in found.of("links") if file.location in locations]
    stay = merged.join(gone, touched_process, "left_anti")
    stay = _merged(stay, F.sum("links"), merged) if added else stay
    remaining = read_files(spark, found, "links", left)
    anew = _merged(remaining.join(gone, touched_process, "left_semi"), F.count(F.lit(1)), remaining)
    return stay.unionByName(anew), kept, [file.path for file in {*added, *removed, *left}]


def upstream_links(standing: DataFrame) -> DataFrame:
    """What feeds each table, and how many links say so, from distinct links."""
    ends = [
        F.coalesce("target", F.lit(V.UNKNOWN_TARGET)).alias("target_fqn"),
        F.coalesce("source", F.lit(V.UNKNOWN_SOURCE)).alias("source_fqn"),
    ]
    return standing.groupBy(*ends).agg(F.sum("links").alias("links"))


def ghost_nodes(standing: DataFrame, entries: DataFrame) -> DataFrame:
    """Endpoints of table links that no catalog entry names, with their link count, from distinct links."""
    counted = (
        standing.where(F.col("level") == V.TABLE_LEVEL)
        .select(F.explode(F.array("source", "target")).alias("fqn"), "links")
        .where(F.col("fqn").isNotNull())
        .groupBy("fqn")
        .agg(F.sum("links").alias("links"))
    )
    return counted.join(entries.select("fqn"), "fqn", "left_anti")
