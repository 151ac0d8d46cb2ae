"""Unregistered endpoints, visibility of edges, and purging."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell import fixed_values as V
from tracewell.functions import process_of
from tracewell.operators.links import declared_links, without_self_links
from tracewell.sources import commits
from tracewell.sources.commits import DataFile
from tracewell.sources.log import LineageLog, append_log, key_of, read_files, read_log, write_files
from tracewell.sources.workspace import exists


def ghost_nodes(log: LineageLog) -> DataFrame:
    """Endpoints of table links that no catalog entry names, with their link count.

    Endpoints are counted first: the anti-join then has one row per FQN,
    however busy it is.
    """
    counted = (
        declared_links(log.links)
        .where(F.col("level") == V.TABLE_LEVEL)
        .select(F.explode(F.array("source_fqn", "target_fqn")).alias("fqn"))
        .where(F.col("fqn").isNotNull())
        .groupBy("fqn")
        .agg(F.count(F.lit(1)).alias("links"))
    )
    return counted.join(log.entries.select("fqn"), "fqn", "left_anti")


def edge_visibility(log: LineageLog) -> DataFrame:
    """How many edges of each level a graph view shows, hides or cannot place.

    What counts is the scheme of the target: tables are shown, with columns;
    storage paths are recorded but hidden; custom names are shown once they
    are registered, and never with columns.
    """
    edges = (
        without_self_links(declared_links(log.links)).select("source_fqn", "target_fqn", "level").distinct()
    )
    entries = log.entries.select(F.col("fqn").alias("target_fqn"), F.lit(True).alias("registered"))
    target = F.col("target_fqn")
    visibility = (
        F.when(target.startswith(V.BIGQUERY), "visible")
        .when(target.startswith(V.GCS), "hidden")
        .when(F.col("level") == V.COLUMN_LEVEL, "no_columns")
        .when(F.col("registered"), "visible")
        .otherwise("ghost")
    )
    return (
        edges.join(entries.distinct(), "target_fqn", "left")
        .groupBy(visibility.alias("visibility"), "level")
        .agg(F.count(F.lit(1)).alias("edges"))
    )


def purge(log: LineageLog, locations: Sequence[str] = V.LOCATIONS) -> LineageLog:
    """What remains when the processes listed in `locations` go, with runs and events.

    Records of other locations cannot belong to a listed process, so only the
    partitions of `locations` take part in the anti-join.
    """
    here = F.col("location").isin(*locations)
    elsewhere = ~here | F.col("location").isNull()
    listed = log.processes.where(here).select(F.col("name").alias("process"))

    def survivors(records: DataFrame, name: str = "name") -> DataFrame:
        orphans = records.where(here).withColumn("process", process_of(F.col(name)))
        orphans = orphans.join(listed, "process", "left_anti").drop("process")
        return records.where(elsewhere).unionByName(orphans)

    return LineageLog(
        log.processes.where(elsewhere),
        survivors(log.runs),
        survivors(log.events),
        survivors(log.links, "event"),
        log.entries,
    )


def purge_counts(log: LineageLog, locations: Sequence[str] = V.LOCATIONS) -> DataFrame:
    """Records that a purge of `locations` removes, per location and kind."""
    here = F.col("location").isin(*locations)
    listed = log.processes.where(here).select(F.col("name").alias("process"))

    def removed(records: DataFrame, kind: str) -> DataFrame:
        inside = records.where(here).select("location", process_of(F.col("name")).alias("process"))
        per_process = inside.groupBy("location", "process").agg(F.count(F.lit(1)).alias("records"))
        return (
            per_process.join(listed, "process", "left_semi")
            .groupBy("location")
            .agg(F.sum("records").alias("records"))
            .select("location", F.lit(kind).alias("kind"), "records")
        )

    return (
        removed(log.processes, "process")
        .unionByName(removed(log.runs, "run"))
        .unionByName(removed(log.events, "event"))
    )


def purge_to(log: LineageLog, root: str, locations: Sequence[str] = V.LOCATIONS) -> None:
    """Write the survivors as a new snapshot; the log that is read stays as it is.

    A root that is there already is refused: its records would stay beside the survivors.
    """
    if exists(log.processes.sparkSession, root):
        raise ValueError(f"cannot write a purged log to {root}: it is there already")
    append_log(purge(log, locations), root)


@dataclass(frozen=True)
class Purged:
    """What a purge did to the files of a log."""

    commit: int
    dropped: int
    rewritten: int
    kept: int


def purge_log(
    spark: SparkSession, root: str, locations: Sequence[str] = V.LOCATIONS, token: str | None = None
) -> Purged:
    """Purge a stored log by one commit that touches only files with records to remove.

    Files of other locations, entries, and files without such records stay as they are, those
    with no others go, and the rest are written again with their survivors. Which is which
    follows from counts per file, made from names alone. The state before the purge stays
    readable. Records that are appended meanwhile are not purged; files that another purge
    or compaction has replaced meanwhile are a Conflict.
    """
    before = commits.state(spark, root)
    listed_in = read_log(spark, root, before.number).processes.where(F.col("location").isin(*locations))
    listed = listed_in.select(F.col("name").alias("process"))
    here = {kind: [f for f in before.of(kind) if f.location in locations] for kind in ("processes", "runs", "events", "links")}
    hits = _records_to_remove(spark, before, here, listed)
    gone = [file for files in here.values() for file in files if hits.get(file.path, 0) == file.rows]
    mixed = {kind: [f for f in files if 0 < hits.get(f.path, 0) < f.rows] for kind, files in here.items()}
    survivors = {}
    for kind, files in mixed.items():
        if files:
            rows = read_files(spark, before, kind, files).withColumn("process", process_of(F.col(key_of(kind))))
            survivors[kind] = rows.join(listed, "process", "left_anti").drop("process")
    again = [file for files in mixed.values() for file in files]
    written = write_files(survivors, root)
    number = commits.commit(spark, root, written, [file.path for file in gone + again], token)
    return Purged(number, len(gone), len(again), len(before.files) - len(gone) - len(again))


def _records_to_remove(
    spark: SparkSession, state: commits.State, files: dict[str, list[DataFile]], listed: DataFrame
) -> dict[str, int]:
    """Number of records of listed processes in each file that has some."""
    paths = [file.path for chosen in files.values() for file in chosen]
    if not paths:
        return {}
    # A process has records in many files, whose paths are long: they go by their hash where that tells them apart.
    hashed = spark.createDataFrame([(path,) for path in paths], "path string").select("path", F.xxhash64("path").alias("file"))
    path_of = {row["file"]: row["path"] for row in hashed.collect()}
    path = F.col("_metadata.file_path")
    file = F.xxhash64(path) if len(path_of) == len(paths) else path
    parts = []
    for kind, chosen in files.items():
        if chosen:
            rows = read_files(spark, state, kind, chosen)
            parts.append(rows.select(file.alias("file"), process_of(F.col(key_of(kind))).alias("process")))
    names = parts[0]
    for part in parts[1:]:
        names = names.unionByName(part)
    # One row per file and process before the join.
    counted = names.groupBy("file", "process").agg(F.count(F.lit(1)).alias("rows"))
    found = counted.join(listed, "process", "left_semi").groupBy("file").agg(F.sum("rows").alias("rows"))
    return {path_of.get(row["file"], row["file"]): row["rows"] for row in found.collect()}
