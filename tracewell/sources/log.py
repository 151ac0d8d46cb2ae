"""The lineage log: processes, runs, events, their links, catalog entries.

Stored as Parquet, one directory per record kind and below it one per append. What
belongs to the log is told by its commits (`commits.py`): an append of all kinds becomes
visible at once, and jobs may append at the same time. All kinds but entries are
partitioned by location and sorted by name, so a query on some locations or processes
reads only those. Links are rows of their own: an event has as many as it declares, at
the positions it gives them. Parents of a record are part of its name, so no parent
columns are stored.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import instant, link_level
from tracewell.sources import commits
from tracewell.sources.commits import Conflict, DataFile
from tracewell.sources.workspace import COMPRESSION

PROCESS_SCHEMA = (
    "name string, display_name string, attributes map<string,string>, "
    "origin struct<source_type:string,name:string>, location string"
)
RUN_SCHEMA = (
    "name string, display_name string, start_time timestamp_ntz, end_time timestamp_ntz, "
    "state string, location string"
)
EVENT_SCHEMA = (
    "name string, start_time timestamp_ntz, end_time timestamp_ntz, location string"
)
LINK_SCHEMA = (
    "event string, start_time timestamp_ntz, link_pos int, "
    "source string, target string, level string, location string"
)
ENTRY_SCHEMA = (
    "entry_id string, entry_type string, fqn string, "
    "entry_source struct<resource:string,system:string,display_name:string>, "
    "aspects map<string,struct<aspect_type:string,"
    "data:struct<format:string,framework:string,path:string>>>"
)

SCHEMAS = {
    "processes": PROCESS_SCHEMA,
    "runs": RUN_SCHEMA,
    "events": EVENT_SCHEMA,
    "links": LINK_SCHEMA,
    "entries": ENTRY_SCHEMA,
}

# Record shapes of a JSON export, one record per line.
PROCESS_JSON = (
    "name string, displayName string, attributes map<string,string>, "
    "origin struct<sourceType:string,name:string>"
)
RUN_JSON = "name string, displayName string, startTime string, endTime string, state string"
EVENT_JSON = (
    "name string, startTime string, endTime string, "
    "links array<struct<source:struct<fullyQualifiedName:string>,"
    "target:struct<fullyQualifiedName:string>,level:string>>"
)
ENTRY_JSON = (
    "entryId string, entryType string, fullyQualifiedName string, "
    "entrySource struct<resource:string,system:string,displayName:string>, "
    "aspects map<string,struct<aspectType:string,"
    "data:struct<format:string,framework:string,path:string>>>"
)


@dataclass(frozen=True)
class LineageLog:
    processes: DataFrame
    runs: DataFrame
    events: DataFrame
    links: DataFrame
    entries: DataFrame

    def only(self, locations: Sequence[str]) -> LineageLog:
        """The part of the log that lies in `locations`; entries have none."""
        here = F.col("location").isin(*locations)
        return LineageLog(
            self.processes.where(here),
            self.runs.where(here),
            self.events.where(here),
            self.links.where(here),
            self.entries,
        )


def create_log(spark: SparkSession, root: str) -> None:
    """An empty log at `root`; a log that is there already stays as it is."""
    commits.create(spark, root)


def key_of(kind: str) -> str:
    """The column that files of a kind are sorted by."""
    return {"links": "event", "entries": "entry_id"}.get(kind, "name")


def write_files(records: Mapping[str, DataFrame], root: str) -> list[DataFile]:
    """Write records of several kinds, not yet part of the log; kinds are written side by side."""
    if not records:
        return []
    folders = {kind: f"{root}/{kind}/append=a{uuid.uuid4().hex}" for kind in records}

    def write(kind: str) -> None:
        df, key = records[kind], key_of(kind)
        if kind == "entries":
            df.write.parquet(folders[kind], compression=COMPRESSION)
        else:
            ordered = df.sortWithinPartitions("location", key)
            ordered.write.partitionBy("location").parquet(folders[kind], compression=COMPRESSION)

    with ThreadPoolExecutor(len(SCHEMAS)) as pool:
        list(pool.map(write, records))
    return _described(next(iter(records.values())).sparkSession, root, folders)


def _described(spark: SparkSession, root: str, folders: Mapping[str, str]) -> list[DataFile]:
    """The files written, from a scan of nothing but the column they are sorted by."""
    parts = []
    for kind, folder in folders.items():
        file = F.col("_metadata")
        location = F.lit(None).cast("string") if kind == "entries" else F.col("location")
        rows = spark.read.schema(SCHEMAS[kind]).option("basePath", f"{root}/{kind}").parquet(folder)
        parts.append(
            rows.select(
                F.lit(kind).alias("kind"),
                file["file_path"].alias("path"),
                file["file_size"].alias("size"),
                location.alias("location"),
                F.col(key_of(kind)).alias("name"),
            )
        )
    files = parts[0]
    for part in parts[1:]:
        files = files.unionByName(part)
    counted = files.groupBy("kind", "path", "size", "location").agg(
        F.count("*").alias("rows"), F.min("name").alias("first"), F.max("name").alias("last")
    )
    return [
        DataFile(
            row["kind"], f"{root}/{row['kind']}", folders[row["kind"]], row["path"], row["location"],
            row["rows"], row["size"], row["first"], row["last"],
        )
        for row in counted.collect()
    ]


def append(root: str, records: Mapping[str, DataFrame], token: str | None = None) -> int:
    """Append records of some kinds as one commit, all of them or none; returns its number.

    An entry whose id is taken is left out, whoever takes it first: if another job
    registers entries meanwhile, those still missing are found anew. A token that is
    there already adds nothing.
    """
    from tracewell.operators.record import missing_entries

    spark = next(iter(records.values())).sparkSession
    create_log(spark, root)
    records = {kind: df.select(*_columns(kind)) for kind, df in records.items()}
    if token and token in (known := commits.state(spark, root).tokens):
        return known[token]
    wanted = records.get("entries")
    written = write_files({kind: df for kind, df in records.items() if kind != "entries"}, root)
    if wanted is None:
        return commits.commit(spark, root, written, token=token)
    token = token or uuid.uuid4().hex
    while True:
        seen = commits.state(spark, root)
        fresh = missing_entries(wanted, _records(spark, seen, "entries")).select(*wanted.columns)
        entries = write_files({"entries": fresh}, root)
        try:
            return commits.commit(
                spark, root, written + entries, token=token, since=seen.number, conflicts=_adds_entries
            )
        except Conflict:
            continue


def _adds_entries(other: commits.Commit) -> bool:
    return any(file.kind == "entries" for file in other.add)


def append_records(df: DataFrame, root: str, kind: str) -> None:
    """Append records of one kind to the stored log, all of them or none."""
    append(root, {kind: df})


def append_log(log: LineageLog, root: str, token: str | None = None) -> int:
    """Append all record kinds as one commit."""
    return append(root, {kind: getattr(log, kind) for kind in SCHEMAS}, token)


def _read(spark: SparkSession, kind: str, paths: Mapping[str, Sequence[str]]) -> DataFrame:
    parts = [
        spark.read.schema(SCHEMAS[kind]).option("basePath", base).parquet(*some) for base, some in paths.items()
    ]
    if not parts:
        return spark.createDataFrame([], SCHEMAS[kind])
    records = parts[0]
    for part in parts[1:]:
        records = records.unionByName(part)
    return records


def _records(spark: SparkSession, found: commits.State, kind: str) -> DataFrame:
    return _read(spark, kind, found.paths(kind)).select(*_columns(kind))


def _columns(kind: str) -> list[str]:
    return [part.split()[0] for part in _top_level(SCHEMAS[kind])]


def _top_level(schema: str) -> list[str]:
    """The fields of a schema text."""
    parts, depth = [""], 0
    for sign in schema:
        depth += (sign == "<") - (sign == ">")
        if sign == "," and not depth:
            parts.append("")
        else:
            parts[-1] += sign
    return parts


def read_files(spark: SparkSession, found: commits.State, kind: str, files: Sequence[DataFile]) -> DataFrame:
    """The records of some files of one kind, with the metadata of their files."""
    chosen: dict[str, list[DataFile]] = {}
    for file in files:
        chosen.setdefault(file.folder, []).append(file)
    paths: dict[str, list[str]] = {}
    for folder, some in sorted(chosen.items()):
        whole = len(some) == found.written[folder]
        paths.setdefault(some[0].base, []).extend([folder] if whole else sorted(file.path for file in some))
    return _read(spark, kind, paths)


def read_log(spark: SparkSession, root: str, as_of: int | None = None) -> LineageLog:
    """The log as of a commit, else the latest."""
    if not commits.is_log(spark, root):
        raise FileNotFoundError(f"there is no log at {root}")
    found = commits.state(spark, root, as_of)
    return LineageLog(**{kind: _records(spark, found, kind) for kind in SCHEMAS})


SMALL_BYTES, TARGET_BYTES = 32 << 20, 128 << 20
#: Records in a packed file: a task sorts them in memory, where they are far larger than in files.
TARGET_ROWS = 1 << 20


def compact(
    spark: SparkSession, root: str, small: int = SMALL_BYTES, target: int = TARGET_BYTES, token: str | None = None
) -> int | None:
    """Pack the small files of a log into sorted larger ones by one commit; returns its number.

    Jobs may append meanwhile: their files are simply not among those that are packed. If
    another compaction or purge has replaced one of these meanwhile, nothing changes and it is
    a Conflict. Readers of earlier states go on with the small files. None if there are not
    at least two small files of a kind and location.
    """
    before = commits.state(spark, root)
    packed: dict[str, list[DataFile]] = {}
    for kind in SCHEMAS:
        groups: dict[str | None, list[DataFile]] = {}
        for file in before.of(kind):
            if file.bytes < small:
                groups.setdefault(file.location, []).append(file)
        packed[kind] = [file for files in groups.values() if len(files) > 1 for file in files]
    records = {}
    for kind, files in packed.items():
        if files:
            rows = read_files(spark, before, kind, files).select(*_columns(kind))
            order = [key_of(kind)] if kind == "entries" else ["location", key_of(kind)]
            parts = -(-sum(file.bytes for file in files) // target)
            parts = max(parts, -(-sum(file.rows for file in files) // TARGET_ROWS))
            records[kind] = rows.repartitionByRange(parts, *order)
    if not records:
        return None
    written = write_files(records, root)
    gone = [file.path for files in packed.values() for file in files]
    if sum(file.rows for file in written) != sum(before.files[path].rows for path in gone):
        raise RuntimeError(f"compaction of {root} would change its number of records")
    number = commits.commit(spark, root, written, gone, token, same=True)
    commits.write_snapshot(spark, root, commits.state(spark, root, number))
    return number


def read_json_log(spark: SparkSession, root: str) -> LineageLog:
    """A JSON export with one directory per record kind and one record per line.

    Damaged lines become records of nulls; `paged.py` reads exports that may be damaged.
    """

    def lines(name: str, schema: str) -> DataFrame:
        return spark.read.schema(schema).json(f"{root}/{name}")

    return log_of_records(
        lines("processes", PROCESS_JSON), lines("runs", RUN_JSON), lines("events", EVENT_JSON), lines("entries", ENTRY_JSON)
    )


def log_of_records(processes: DataFrame, runs: DataFrame, events: DataFrame, entries: DataFrame) -> LineageLog:
    """A log from records in the shapes of a JSON export, times parsed once."""
    location = F.substring_index(F.substring_index("name", "/", 4), "/", -1).alias("location")
    processes = processes.select(
        "name",
        F.col("displayName").alias("display_name"),
        "attributes",
        F.when(
            F.col("origin").isNotNull(),
            F.struct(F.col("origin.sourceType").alias("source_type"), F.col("origin.name").alias("name")),
        ).alias("origin"),
        location,
    )
    runs = runs.select(
        "name",
        F.col("displayName").alias("display_name"),
        instant(F.col("startTime")).alias("start_time"),
        instant(F.col("endTime")).alias("end_time"),
        "state",
        location,
    )
    timed = events.select(
        "name",
        instant(F.col("startTime")).alias("start_time"),
        instant(F.col("endTime")).alias("end_time"),
        "links",
        location,
    )
    events = timed.drop("links")
    links = timed.select(
        F.col("name").alias("event"), "start_time", F.posexplode("links").alias("link_pos", "link"), "location"
    ).select("event", "start_time", "link_pos", *_stored_link(F.col("link")), "location")
    entries = entries.select(
        F.col("entryId").alias("entry_id"),
        F.col("entryType").alias("entry_type"),
        F.col("fullyQualifiedName").alias("fqn"),
        F.when(
            F.col("entrySource").isNotNull(),
            F.struct(
                F.col("entrySource.resource").alias("resource"),
                F.col("entrySource.system").alias("system"),
                F.col("entrySource.displayName").alias("display_name"),
            ),
        ).alias("entry_source"),
        F.transform_values(
            "aspects",
            lambda _, aspect: F.struct(
                aspect["aspectType"].alias("aspect_type"), aspect["data"].alias("data")
            ),
        ).alias("aspects"),
    )
    return LineageLog(processes, runs, events, links, entries)


def _stored_link(link):
    source = link["source"]["fullyQualifiedName"]
    target = link["target"]["fullyQualifiedName"]
    level = F.coalesce(link["level"], link_level(source, target))
    return source.alias("source"), target.alias("target"), level.alias("level")
