"""Small hand-written lineage logs."""

from __future__ import annotations

from datetime import datetime

from tracewell.sources.log import LineageLog, SCHEMAS

NOON = datetime(2026, 1, 1, 12)


def process_name(location, name):
    return f"projects/p/locations/{location}/processes/{name}"


def process(location, name, origin=None, job=None, display=None, **properties):
    attributes = dict(properties)
    if job is not None:
        attributes["custom_job_id"] = job
    return (process_name(location, name), display, attributes, ("CUSTOM", origin), location)


def run(location, process, name, state="COMPLETED", start=NOON):
    return (f"{process_name(location, process)}/runs/{name}", None, start, start, state, location)


def event(location, process, run, name, links, start=NOON):
    full = f"{process_name(location, process)}/runs/{run}/lineageEvents/{name}"
    shaped = None if links is None else [(*link, "table")[:3] for link in links]
    return (full, start, None, location, shaped)


def entry(entry_id, fqn):
    return (entry_id, "kind", fqn, None, None)


def lineage_log(spark, processes=(), runs=(), events=(), entries=()):
    """Events are given with their links, or None."""
    links = [
        (name, start, pos, *link, location)
        for name, start, _, location, shaped in events
        for pos, link in enumerate(shaped or ())
    ]
    events = [row[:4] for row in events]
    rows = {"processes": processes, "runs": runs, "events": events, "links": links, "entries": entries}
    return LineageLog(
        **{kind: spark.createDataFrame(list(rows[kind]), schema) for kind, schema in SCHEMAS.items()}
    )


def rows(df, *columns):
    return sorted((tuple(row) for row in df.select(*columns).collect()), key=repr)
