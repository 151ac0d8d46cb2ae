from __future__ import annotations

import pytest
from records import entry, event, lineage_log, process, process_name, rows, run

from tracewell.operators import audit
from tracewell.sources.log import append_log, read_log


def test_ghost_nodes(spark):
    log = lineage_log(
        spark,
        events=[
            event("us", "a", "r", "e1", [("custom:a", "custom:b"), ("custom:a", "custom:c"), (None, "custom:c")]),
            event("us", "a", "r", "e2", [("custom:a.x", "custom:b.y", "column")]),
        ],
        entries=[entry("1", "custom:b")],
    )
    assert rows(audit.ghost_nodes(log), "fqn", "links") == [("custom:a", 2), ("custom:c", 2)]


def test_visibility(spark):
    log = lineage_log(
        spark,
        events=[
            event("us", "a", "r", "e1", [
                ("gcs:a", "bigquery:p.d.t"),
                ("bigquery:p.d.t.x", "bigquery:p.d.u.y", "column"),
                ("gcs:a", "gcs:b"),
                ("custom:a", "custom:known"),
                ("custom:a", "custom:unknown"),
                ("custom:a.x", "custom:known.y", "column"),
                ("gcs:a", "gcs:a"),
            ]),
            event("us", "a", "r", "e2", [("gcs:a", "gcs:b")]),
        ],
        entries=[entry("1", "custom:known"), entry("2", "custom:known")],
    )
    assert rows(audit.edge_visibility(log), "visibility", "level", "edges") == [
        ("ghost", "table", 1),
        ("hidden", "table", 1),
        ("no_columns", "column", 1),
        ("visible", "column", 1),
        ("visible", "table", 2),
    ]


@pytest.fixture()
def log(spark):
    return lineage_log(
        spark,
        [process("us-east1", "a"), process("us", "b")],
        [run("us-east1", "a", "r"), run("us", "b", "r"), run("us-east1", "unlisted", "r")],
        [
            event("us-east1", "a", "r", "e1", [("s", "t")]),
            event("us-east1", "a", "r", "e2", None),
            event("us", "b", "r", "e1", [("s", "t")]),
            event("us-east1", "unlisted", "r", "e1", []),
        ],
        [entry("1", "s")],
    )


def test_purge_takes_everything_below_a_process(log):
    left = audit.purge(log, ["us-east1"])
    kept = {process_name("us", "b"), process_name("us-east1", "unlisted")}
    assert rows(left.processes, "name") == [(process_name("us", "b"),)]
    for records in (left.runs, left.events):
        assert {"/".join(row.name.split("/")[:6]) for row in records.collect()} == kept
    assert left.entries.count() == 1


def test_purge_everywhere_leaves_no_orphans(log):
    left = audit.purge(log)
    assert left.processes.count() == 0
    assert rows(left.runs, "location") == [("us-east1",)]  # of a process that is not listed


def test_records_without_a_location_stay(spark):
    log = lineage_log(spark, [(process_name("us", "a"), None, {}, None, None)])
    assert audit.purge(log).processes.count() == 1


def test_purge_counts_add_up(log):
    counts = audit.purge_counts(log, ["us-east1", "us"])
    assert rows(counts, "location", "kind", "records") == [
        ("us", "event", 1), ("us", "process", 1), ("us", "run", 1),
        ("us-east1", "event", 2), ("us-east1", "process", 1), ("us-east1", "run", 1),
    ]


def test_purge_writes_a_new_snapshot(spark, log, path):
    append_log(log, path("log"))
    stored = read_log(spark, path("log"))
    audit.purge_to(stored, path("kept"), ["us-east1"])
    kept = read_log(spark, path("kept"))
    assert (stored.events.count(), kept.events.count()) == (4, 2)
    assert kept.events.schema == stored.events.schema
    with pytest.raises(ValueError, match="already"):
        audit.purge_to(stored, path("log"), ["us-east1"])
