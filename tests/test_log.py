from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime
from pathlib import Path

from records import NOON, event, lineage_log, process, process_name, rows, run

from tracewell.sources.log import append_log, append_records, create_log, read_json_log, read_log


def write_lines(folder, records):
    folder = Path(folder)
    folder.mkdir(parents=True)
    (folder / "part-0.json").write_text("\n".join(json.dumps(record) for record in records))


def test_records_come_back_as_written(spark, path):
    log = lineage_log(
        spark,
        [process("us", "a", "batch-1", "job", "A")],
        [run("us", "a", "r")],
        [event("us", "a", "r", "e", [("s", "t")])],
        [("id", "kind", "s", ("r", "sys", "S"), {"k": ("at", ("parquet", "f", "p"))})],
    )
    append_log(log, path("log"))
    stored = read_log(spark, path("log"))
    for kind in ("processes", "runs", "events", "links", "entries"):
        assert getattr(stored, kind).collect() == getattr(log, kind).collect()


def test_empty_log_can_be_read_and_appended_to(spark, path):
    create_log(spark, path("log"))
    assert read_log(spark, path("log")).events.count() == 0
    append_log(lineage_log(spark, [process("us", "a")]), path("log"))
    create_log(spark, path("log"))
    assert read_log(spark, path("log")).processes.count() == 1


def test_only_some_locations(spark, path):
    append_log(
        lineage_log(spark, [process("us", "a"), process("us-east1", "b"), process("eu", "c")]), path("log")
    )
    some = read_log(spark, path("log")).only(["us", "us-east1"])
    assert rows(some.processes, "name") == [(process_name("us-east1", "b"),), (process_name("us", "a"),)]
    plan = some.processes._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [location" in plan


def test_json_export(spark, path):
    name = process_name("us-east1", "x")
    write_lines(
        path("in/processes"),
        [
            {"name": name, "displayName": "X", "attributes": {"custom_job_id": "j"},
             "origin": {"sourceType": "CUSTOM", "name": "o"}},
            {"name": process_name("us", "bare")},
        ],
    )
    write_lines(
        path("in/runs"),
        [{"name": f"{name}/runs/r", "startTime": "2026-01-01T12:00:00Z",
          "endTime": "2026-01-01T14:00:00+02:00", "state": "COMPLETED"}],
    )
    write_lines(
        path("in/events"),
        [
            {"name": f"{name}/runs/r/lineageEvents/e", "startTime": "2026-01-01T12:00:00Z",
             "links": [{"source": {"fullyQualifiedName": "bigquery:p.n.t.a"},
                        "target": {"fullyQualifiedName": "bigquery:p.n.u.b"}},
                       {"target": {"fullyQualifiedName": "gcs:b.x"}}]},
            {"name": f"{name}/runs/r/lineageEvents/none"},
        ],
    )
    write_lines(
        path("in/entries"),
        [{"entryId": "i", "fullyQualifiedName": "custom:n.b", "entryType": "t",
          "entrySource": {"resource": "r", "system": "s", "displayName": "d"},
          "aspects": {"k": {"aspectType": "at", "data": {"format": "parquet", "framework": "f", "path": "p"}}}}],
    )
    log = read_json_log(spark, path("in"))
    assert rows(log.processes, "location", "display_name", "origin.name") == [
        ("us", None, None), ("us-east1", "X", "o"),
    ]
    assert rows(log.runs, "start_time", "end_time") == [(NOON, datetime(2026, 1, 1, 12))]
    assert rows(log.links, "source", "target", "level") == sorted(
        [("bigquery:p.n.t.a", "bigquery:p.n.u.b", "column"), (None, "gcs:b.x", "table")], key=repr
    )
    got = log.entries.first()
    assert got.entry_source.display_name == "d" and got.aspects["k"].data.path == "p"
    append_log(log, path("out"))
    assert read_log(spark, path("out")).events.count() == 2


def test_appends_at_the_same_time_lose_nothing(spark, path):
    root, per_writer = path("log"), 300
    create_log(spark, root)

    def write(number):
        log = lineage_log(spark, [process("us", f"w{number}-{i}") for i in range(per_writer)])
        append_log(log, root)

    def fail():
        broken = spark.range(5).selectExpr("raise_error('broken') AS name", "'us' AS location")
        append_records(broken, root, "processes")

    with ThreadPoolExecutor(8) as pool:
        done = [pool.submit(write, number) for number in range(6)]
        failed = [pool.submit(fail) for _ in range(2)]
    assert not any(future.exception() for future in done)
    assert all(future.exception() for future in failed)
    found = read_log(spark, root).processes
    assert found.count() == found.select("name").distinct().count() == 6 * per_writer
