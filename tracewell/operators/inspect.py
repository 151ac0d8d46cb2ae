"""Lineage by batch and by table, for all batches and tables at once.

A question about one batch or table is a filter on the answer.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell import fixed_values as V
from tracewell.functions import normalise_identifier, process_of, run_of
from tracewell.operators.links import (
    busy_processes,
    dealing,
    dealt_by,
    edges_per_process,
    flatten_links,
    without_self_links,
)
from tracewell.sources.log import LineageLog


def location_rank(location: Column, locations: Sequence[str] = V.LOCATIONS) -> Column:
    """Place of a location in lookup order, from 1."""
    return F.array_position(F.array(*map(F.lit, locations)), location)


def _batch_texts() -> tuple[Column, Column]:
    """Where a process mentions its batch: the origin name and the job id."""
    return F.col("origin.name"), F.col("attributes").getItem(V.JOB_ID)


def processes_of_batch(processes: DataFrame, batch_id: str) -> DataFrame:
    """All processes whose origin name or job id contains `batch_id`."""
    origin, job_id = (F.coalesce(text.contains(batch_id), F.lit(False)) for text in _batch_texts())
    return processes.where(origin | job_id)


def edges_of_batch(log: LineageLog, batch_id: str, locations: Sequence[str] = V.LOCATIONS) -> DataFrame:
    """Distinct edges of the first process that mentions one batch."""
    found = processes_of_batch(log.only(locations).processes, batch_id)
    rank = location_rank(F.col("location"), locations).alias("rank")
    first = found.agg(F.min(F.struct(rank, "name", "location")).alias("first"))
    process = first.select("first.name").scalar()
    # Events are sorted by name, and all names below the process lie between its name
    # with a slash and with the sign after that.
    event = F.col("event")
    below = (event >= F.concat(process, F.lit("/"))) & (event < F.concat(process, F.lit("0")))
    here = F.col("location") == first.select("first.location").scalar()
    return edges_per_process(log.links.where(here & below))


def process_of_batches(
    processes: DataFrame, batches: DataFrame, locations: Sequence[str] = V.LOCATIONS
) -> DataFrame:
    """For each batch the first process that mentions it: batch_id, process, location.

    "Contains" is turned into an equi-join: every process text gives its
    substrings of the lengths that batch ids have. Texts are names, so that is
    a bounded number of rows each. The first process per substring is taken
    before the join, hence a part shared by all names costs one row and not
    one per process. Batches without a process are left out.
    """
    batches = batches.select("batch_id").distinct()
    rank = location_rank(F.col("location"), locations).alias("rank")
    lengths = batches.select(F.collect_set(F.length("batch_id")))
    by_text = (
        processes.where(F.col("location").isin(*locations))
        .select(F.struct(rank, "name", "location").alias("hit"), F.explode(F.array(*_batch_texts())).alias("text"))
        .where(F.col("text").isNotNull())
        .groupBy("text")
        .agg(F.min("hit").alias("hit"))
    )
    pieces = by_text.select(
        "hit", "text", F.explode(lengths.scalar()).alias("size")
    ).where(F.col("size") <= F.length("text"))
    starts = F.sequence(F.lit(1), F.length("text") - F.col("size") + 1)
    by_piece = (
        pieces.select("hit", "text", "size", F.explode(starts).alias("start"))
        .select("hit", F.substring(F.col("text"), F.col("start"), F.col("size")).alias("batch_id"))
        .groupBy("batch_id")
        .agg(F.min("hit").alias("hit"))
    )
    return batches.join(by_piece, "batch_id").select(
        "batch_id", F.col("hit.name").alias("process"), F.col("hit.location").alias("location")
    )


def runs_of_processes(log: LineageLog) -> DataFrame:
    """Runs with the process they belong to."""
    runs = log.runs.select(
        process_of(F.col("name")).alias("process"), F.col("name").alias("run"), "state", "start_time"
    )
    # A process that was delivered twice is still one.
    return runs.join(log.processes.select(F.col("name").alias("process")), "process", "left_semi").select(
        "process", "run", "state", "start_time"
    )


def events_in_context(log: LineageLog) -> DataFrame:
    """Events that a walk from process to run to event comes to.

    Events and links are dealt once, by run, and counted and joined there. Where there are hot
    runs, they are dealt by event and once more by run, for a join that may split these.
    """
    named = log.events.select(F.col("name").alias("event"))
    how = dealing(named, log.links)
    events = named.select("event", F.lit(1).alias("events"), F.lit(0).alias("links"))
    links = log.links.select("event", F.lit(0).alias("events"), F.lit(1).alias("links"))
    rows = events.unionByName(links).where(F.col("event").isNotNull())
    run = run_of(F.col("event")).alias("run")
    keys = ["event"] if how.hot else [run, "event"]
    dealt = rows if how.hot else how.deal(rows, run_of(F.col("event")))
    counted = dealt.groupBy(*keys).agg(F.sum("events").cast("int").alias("events"), F.sum("links").cast("int").alias("links"))
    # An event that was delivered twice is two rows.
    often = F.explode(F.array_repeat(F.lit(True), F.col("events")))
    found = counted.select(run, "event", "links", often).drop("col")
    return found.join(runs_of_processes(log).select("run", "process", "state"), "run")


def process_activity(log: LineageLog, processes: DataFrame | None = None) -> DataFrame:
    """Per process: events, and distinct edges other than self-links.

    `processes` (column `process`) narrows the report before anything is counted.
    The distinct count is spread over (process, edge) before it is added up
    per process.
    """
    events = log.events.select(process_of(F.col("name")).alias("process"))
    moves = without_self_links(flatten_links(log.links)).select(
        process_of(F.col("event")).alias("process"), "source_fqn", "target_fqn"
    )
    if processes is not None:
        wanted = processes.select("process").distinct()
        events, moves = (rows.join(wanted, "process", "left_semi") for rows in (events, moves))
    edges = moves.distinct().groupBy("process").agg(F.count(F.lit(1)).alias("edges"))
    counted = events.groupBy("process").agg(F.count(F.lit(1)).alias("events"))
    return counted.join(edges, "process", "left").withColumn("edges", F.coalesce("edges", F.lit(0)))


def batch_status(log: LineageLog, batches: DataFrame, locations: Sequence[str] = V.LOCATIONS) -> DataFrame:
    """Validation of each batch: its process, event and edge counts, and a status."""
    found = process_of_batches(log.processes, batches, locations)
    report = (
        batches.select("batch_id")
        .distinct()
        .join(found, "batch_id", "left")
        .join(process_activity(log, found), "process", "left")
    )
    events = F.coalesce("events", F.lit(0))
    edges = F.coalesce("edges", F.lit(0))
    status = (
        F.when(F.col("process").isNull(), "NO_PROCESS")
        .when(events == 0, "NO_EVENTS")
        .when(edges == 0, "ONLY_SELF_READS")
        .otherwise("OK")
    )
    return report.select(
        "batch_id", "process", "location", events.alias("events"), edges.alias("edges"), status.alias("status")
    )


def events_by_source(links: DataFrame) -> DataFrame:
    """One row per event and FQN it reads."""
    return reduce(DataFrame.unionByName, _reads(links, links))


def _reads(links: DataFrame, logged: DataFrame, busy: Sequence[int] | None = None) -> list[DataFrame]:
    """`events_by_source` of some of the links `logged`, dealt by process; reads of busy ones come apart, dealt by event and FQN.

    A log is sorted by name, so rows dealt by process have most of their text in common with the
    row before. Few come again, so there is nothing to collapse before the shuffle.
    """
    busy = busy_processes(logged) if busy is None else busy
    process = process_of(F.col("event"))
    reads = links.where(F.col("source").isNotNull()).select("event", F.col("source").alias("source_fqn"))
    total = logged.count()

    def distinct(rows: DataFrame, *keys: Column | str) -> DataFrame:
        named = dealt_by(rows, total, *keys).select("event", "source_fqn", process.alias("process")).distinct()
        return named.select("event", "source_fqn", run_of(F.col("event")).alias("run"), "process")

    if not busy:
        return [distinct(reads, process)]
    is_busy = F.xxhash64(process).isin(*busy)
    return [distinct(reads.where(~is_busy), process), distinct(reads.where(is_busy), "event", "source_fqn")]


def _reads_with_details(links: DataFrame, log: LineageLog) -> DataFrame:
    """Reads are shuffled once, dealt by process, to be told apart and to meet details there; of busy processes, details are few."""
    busy = busy_processes(log.links)
    others, *hot = _reads(links, log.links, busy)
    parts = [with_process_details(others, log.processes)]
    for reads in hot:
        parts.append(with_process_details(reads, log.processes.where(F.xxhash64("name").isin(*busy))))
    return reduce(DataFrame.unionByName, parts)


def with_process_details(reads: DataFrame, processes: DataFrame) -> DataFrame:
    # One row per process, also where it was delivered twice.
    details = (
        processes.groupBy(F.col("name").alias("process"))
        .agg(F.min(F.struct("display_name", F.col("origin.name").alias("origin_name"))).alias("details"))
        .select("process", "details.*")
    )
    missing = F.lit(V.MISSING_DETAIL)
    return reads.join(details, "process", "left").withColumns(
        {
            "display_name": F.coalesce("display_name", missing),
            "origin_name": F.coalesce("origin_name", missing),
        }
    )


def runs_by_source(log: LineageLog) -> DataFrame:
    """Which runs and processes read each FQN, one row per event."""
    return _reads_with_details(log.links, log)


def gated_runs_by_source(log: LineageLog, identifiers: DataFrame | None = None) -> DataFrame:
    """As `runs_by_source`, but only for FQNs that some link writes to.

    This is the by-table report with its two steps: no link to the table, no
    answer; else the events that read it. A table that is only read is
    therefore left out, use `runs_by_source` for those. `identifiers` (column
    `identifier`, FQN or plain table name) narrows the report.

    The written FQNs are one row each, so they spread evenly.
    """
    links = log.links
    written = links.select(F.col("target").alias("source_fqn")).distinct()
    if identifiers is not None:
        asked = identifiers.select(normalise_identifier(F.col("identifier")).alias("source_fqn"))
        asked = asked.distinct()
        written = written.join(asked, "source_fqn", "left_semi")
        links = links.join(asked.withColumnRenamed("source_fqn", "source"), "source", "left_semi")
    # The gate comes first: only what passes is dealt once more, and with nothing that follows from its name.
    reads = links.where(F.col("source").isNotNull()).select("event", "source")
    gated = reads.join(written.withColumnRenamed("source_fqn", "source"), "source", "left_semi")
    found = _reads_with_details(gated, log)
    return found.select("process", "source_fqn", "event", "run", "display_name", "origin_name")


def run_details(log: LineageLog) -> DataFrame:
    """Every run that events name, with its record where there is one."""
    named = log.events.select(run_of(F.col("name")).alias("run")).distinct()
    details = log.runs.select(F.col("name").alias("run"), "state", "start_time", "end_time")
    return named.join(details, "run", "left")
