"""Lineage records from jobs, links and paths, in bulk.

Jobs are rows: project, location, job_id, job_name, run_name, started_at
(timestamp_ntz) and, where they declare lineage, links (array of source,
target, level). Where there is a column `ended_at`, runs and events
end then. Where there is a map column `properties`, processes keep it as
further attributes. A single job is a frame of one row. Edges are what the job
declares; nothing is derived from query plans.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell import fixed_values as V
from tracewell.functions import custom_fqn, system_resource

log = logging.getLogger(__name__)

JOB_SCHEMA = (
    "project string, location string, job_id string, job_name string, run_name string, "
    "started_at timestamp_ntz, links array<struct<source:string,target:string,level:string>>"
)


def link(source: Column, target: Column, level: str = V.TABLE_LEVEL) -> Column:
    return F.struct(source.alias("source"), target.alias("target"), F.lit(level).alias("level"))


def _parent() -> Column:
    return F.concat(F.lit("projects/"), F.col("project"), F.lit("/locations/"), F.col("location"))


def _process_name() -> Column:
    """A process per posting: the same job at another time is another process.

    The id follows from the job row, so a task that is run again writes the
    same name.
    """
    posted = F.md5(F.concat_ws("|", "job_id", F.col("started_at").cast("string")))
    return F.concat(_parent(), F.lit("/processes/"), posted)


def _run_name() -> Column:
    return F.concat(_process_name(), F.lit("/runs/"), F.md5("run_name"))


def process_records(jobs: DataFrame) -> DataFrame:
    attributes = F.create_map(F.lit(V.JOB_ID), F.col("job_id"))
    if "properties" in jobs.columns:
        attributes = F.map_concat(attributes, F.col("properties"))
    posted = jobs.select(
        _process_name().alias("name"),
        F.col("job_name").alias("display_name"),
        attributes.alias("attributes"),
        F.struct(F.lit(V.CUSTOM_ORIGIN).alias("source_type"), _parent().alias("name")).alias("origin"),
        "location",
    )
    return _one_per_name(posted, "display_name", F.to_json("attributes"))


def _one_per_name(records: DataFrame, *order: str | Column) -> DataFrame:
    """Several runs of a job at one time are one process, and a run delivered twice is one run."""
    first = F.min_by(F.struct(*records.columns), F.struct(*order)).alias("first")
    return records.groupBy("name").agg(first).select("first.*")


def _ended(jobs: DataFrame) -> Column:
    return F.col("ended_at") if "ended_at" in jobs.columns else F.lit(None).cast("timestamp_ntz")


def run_records(jobs: DataFrame) -> DataFrame:
    """A run that does not say when it ended is recorded when its work is done: it starts and ends at once."""
    runs = jobs.select(
        _run_name().alias("name"),
        F.col("run_name").alias("display_name"),
        F.col("started_at").alias("start_time"),
        F.coalesce(_ended(jobs), "started_at").alias("end_time"),
        F.lit(V.COMPLETED).alias("state"),
        "location",
    )
    return _one_per_name(runs, "display_name", "end_time")


def _declared(jobs: DataFrame) -> DataFrame:
    """Each link that a run declares, once, with the event that records it.

    The event is named by its link, so a run that is delivered in parts, or twice, has
    each of its links once, whatever their order.
    """
    parts = [F.coalesce(F.col(f"link.{name}"), F.lit("\\N")) for name in ("level", "source", "target")]
    named = F.md5(F.concat_ws("\n", *parts))
    declared = jobs.select(
        _run_name().alias("run"), "started_at", _ended(jobs).alias("end_time"), "location", F.explode("links").alias("link")
    )
    events = declared.withColumn("event", F.concat("run", F.lit("/lineageEvents/"), named))
    first = F.min_by(F.struct("started_at", "end_time", "location", "link"), F.struct("end_time")).alias("first")
    return events.groupBy("event").agg(first).select("event", "first.*")


def event_records(jobs: DataFrame) -> DataFrame:
    """One event per declared link."""
    return _declared(jobs).select(
        F.col("event").alias("name"), F.col("started_at").alias("start_time"), "end_time", "location"
    )


def link_records(jobs: DataFrame) -> DataFrame:
    """The one link of each event of `event_records`."""
    return _declared(jobs).select(
        "event",
        F.col("started_at").alias("start_time"),
        F.lit(0).alias("link_pos"),
        "link.source",
        "link.target",
        "link.level",
        "location",
    )


def events_from_links(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Event and link records from link rows: event, start_time, location, link_pos, endpoints, level.

    Where there is a column `end_time`, events keep it. An event has one record
    and all its links, however many, at the positions they were given. A link
    delivered twice at its position counts once, which also makes the write
    safe to repeat. Where there is a column `dealt` (see `links.with_ends`), rows
    are told apart in the tasks that they were dealt to.
    """
    dealt = [name for name in ("dealt",) if name in links.columns]
    end = F.col("end_time") if "end_time" in links.columns else F.lit(None).cast("timestamp_ntz")
    events = links.select(*dealt, F.col("event").alias("name"), "start_time", end.alias("end_time"), "location")
    rows = links.select(
        *dealt,
        "event",
        "start_time",
        "link_pos",
        F.col("source_fqn").alias("source"),
        F.col("target_fqn").alias("target"),
        "level",
        "location",
    )
    return events.distinct().drop(*dealt), rows.distinct().drop(*dealt)


def entry_records(paths: DataFrame, entry_type: str, aspect: str, aspect_type: str) -> DataFrame:
    """Catalog entries for paths: entry_id, namespace, path, display_name."""
    data = F.struct(
        F.lit(V.ASPECT_FORMAT).alias("format"),
        F.lit(V.ASPECT_FRAMEWORK).alias("framework"),
        F.col("path").alias("path"),
    )
    return paths.select(
        "entry_id",
        F.lit(entry_type).alias("entry_type"),
        custom_fqn(F.col("namespace"), F.col("path")).alias("fqn"),
        F.struct(
            system_resource(F.col("path")).alias("resource"),
            F.lit(V.STORAGE_SYSTEM).alias("system"),
            F.col("display_name").alias("display_name"),
        ).alias("entry_source"),
        F.create_map(
            F.lit(aspect), F.struct(F.lit(aspect_type).alias("aspect_type"), data.alias("data"))
        ).alias("aspects"),
    )


def missing_entries(wanted: DataFrame, existing: DataFrame) -> DataFrame:
    """Those of `wanted` whose id is not taken; an existing entry stays untouched.

    Of several with one new id, the one with the least FQN is created, and of
    those with one FQN the one with the least resource and aspects.
    """
    record = F.struct(*wanted.columns)
    fresh = wanted.join(existing.select("entry_id"), "entry_id", "left_anti")
    order = F.struct("fqn", "entry_source.resource", F.to_json("aspects"))
    first = fresh.groupBy("entry_id").agg(F.min_by(record, order).alias("record"))
    return first.select("record.*")


@dataclass(frozen=True)
class Emission:
    """Outcome of recording lineage after the data was written."""

    ok: bool
    error: str | None = None


def best_effort(emit: Callable[[], None]) -> Emission:
    """Record lineage; a failure is logged and reported, never raised.

    Data that is already written stands whether or not its lineage is recorded.
    """
    try:
        emit()
    except Exception as error:  # any failure of the log must leave the job successful
        log.warning("lineage was not recorded: %s", error)
        return Emission(False, str(error))
    return Emission(True)
