from __future__ import annotations

import random
from datetime import datetime

from records import NOON, event, lineage_log, process, process_name, rows, run

from tracewell.operators import inspect, links
from tracewell.fixed_values import LOCATIONS

EARLIER = datetime(2026, 1, 1, 11)


def batches(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "batch_id string")


def test_defaults_then_self_links_then_first_seen(spark):
    log = lineage_log(
        spark,
        events=[
            event("us", "a", "r2", "e1", [("s", "t"), (None, "t"), (None, None)]),
            event("us", "a", "r1", "e9", [("s", "t"), ("x", "x"), (None, "Unknown_Source")], EARLIER),
            event("us", "b", "r1", "e1", [("s", "t"), ("gcs:b.d", "t")]),
            event("us", "b", "r1", "e2", None),
            event("us", "b", "r1", "e3", []),
        ],
    )
    a, b = process_name("us", "a"), process_name("us", "b")
    got = links.edges_per_process(log.links)
    assert rows(got, "process", "source_fqn", "target_fqn", "run") == sorted(
        [
            (a, "s", "t", f"{a}/runs/r1"),
            (a, "Unknown_Source", "t", f"{a}/runs/r2"),
            (a, "Unknown_Source", "Unknown_Target", f"{a}/runs/r2"),
            (b, "s", "t", f"{b}/runs/r1"),
            (b, "gcs:b.d", "t", f"{b}/runs/r1"),
        ],
        key=repr,
    )
    assert rows(got.where("source_fqn like 'gcs%'"), "source_path", "target_path") == [("gs://b/d", "t")]
    whole = links.edges_first_seen(log.links)
    assert whole.count() == 4
    assert rows(whole.where("source_fqn = 's'"), "event") == [(f"{a}/runs/r1/lineageEvents/e9",)]


def test_equal_times_fall_back_to_the_event_name(spark):
    log = lineage_log(
        spark, events=[event("us", "a", "r", name, [("s", "t")]) for name in ("e2", "e1", "e3")]
    )
    (only,) = links.edges_per_process(log.links).collect()
    assert only.event.endswith("/e1")


def test_dedup_is_idempotent(spark):
    log = lineage_log(spark, events=[event("us", "a", "r", "e", [("s", "t"), ("s", "t")])])
    once = links.edges_per_process(log.links)
    assert once.count() == links.edges_per_process(log.links.unionAll(log.links)).count() == 1


def test_first_process_in_location_order(spark):
    log = lineage_log(
        spark,
        [
            process("us", "a", "run-batch-1-x"),
            process("us-central1", "z", "batch-1"),
            process("us-central1", "m", None, "prefix-batch-1"),
            process("elsewhere", "a", "batch-1"),
            process("us", "only", "other"),
        ],
    )
    got = inspect.process_of_batches(log.processes, batches(spark, "batch-1", "other", "none", "batch-1"))
    assert rows(got, "batch_id", "process", "location") == [
        ("batch-1", process_name("us-central1", "m"), "us-central1"),
        ("other", process_name("us", "only"), "us"),
    ]
    assert inspect.processes_of_batch(log.processes, "batch-1").count() == 4


def test_batch_ids_are_no_patterns(spark):
    log = lineage_log(spark, [process("us", "a", "axb"), process("us", "b", "a_b%")])
    got = inspect.process_of_batches(log.processes, batches(spark, "a_b", "%", "."))
    assert rows(got, "batch_id", "process") == [("%", process_name("us", "b")), ("a_b", process_name("us", "b"))]


def test_contains_against_brute_force(spark):
    random.seed(7)
    word = lambda size: "".join(random.choice("abé-") for _ in range(size))
    records = [
        process(random.choice(LOCATIONS), f"p{i:03d}", word(random.randint(0, 8)),
                random.choice([None, word(4)]))
        for i in range(120)
    ]
    ids = sorted({word(random.randint(0, 4)) for _ in range(60)})
    log = lineage_log(spark, records)
    expected = []
    for batch in ids:
        hits = [
            (LOCATIONS.index(r[4]), r[0], r[4])
            for r in records
            if batch in (r[3][1] or "") or batch in r[2].get("custom_job_id", "")
        ]
        if hits:
            _, name, location = min(hits)
            expected.append((batch, name, location))
    got = inspect.process_of_batches(log.processes, batches(spark, *ids))
    assert rows(got, "batch_id", "process", "location") == sorted(expected, key=repr)


def test_status_of_each_batch(spark):
    log = lineage_log(
        spark,
        [process("us", name, f"batch-{name}") for name in ("ok", "idle", "self", "bare")],
        events=[
            event("us", "ok", "r", "e1", [("s", "t"), ("s", "s"), ("s", "t")]),
            event("us", "ok", "r", "e2", [("s", "u")]),
            event("us", "self", "r", "e1", [("s", "s")]),
            event("us", "bare", "r", "e1", None),
            event("us", "bare", "r", "e2", []),
        ],
    )
    asked = batches(spark, *[f"batch-{name}" for name in ("ok", "idle", "self", "bare", "lost")])
    got = inspect.batch_status(log, asked)
    assert rows(got, "batch_id", "events", "edges", "status") == [
        ("batch-bare", 2, 0, "ONLY_SELF_READS"),
        ("batch-idle", 0, 0, "NO_EVENTS"),
        ("batch-lost", 0, 0, "NO_PROCESS"),
        ("batch-ok", 2, 2, "OK"),
        ("batch-self", 1, 0, "ONLY_SELF_READS"),
    ]


def test_edges_of_one_batch(spark):
    log = lineage_log(
        spark,
        [process("us", "b", "batch-1"), process("us-east1", "a", "batch-1")],
        events=[event("us", "b", "r", "e", [("s", "t")]), event("us-east1", "a", "r", "e", [("u", "v")])],
    )
    assert rows(inspect.edges_of_batch(log, "batch-1"), "source_fqn", "target_fqn") == [("u", "v")]
    assert inspect.edges_of_batch(log, "batch-1", ["us"]).first().source_fqn == "s"
    assert inspect.edges_of_batch(log, "nothing").count() == 0


def test_walk_from_process_to_event(spark):
    log = lineage_log(
        spark,
        [process("us", "a")],
        [run("us", "a", "r1"), run("us", "gone", "r1")],
        [
            event("us", "a", "r1", "e1", [("s", "t")]),
            event("us", "a", "r1", "e2", None),
            event("us", "a", "unrecorded", "e1", [("s", "t")]),
            event("us", "gone", "r1", "e1", [("s", "t")]),
        ],
    )
    assert rows(inspect.runs_of_processes(log), "run") == [(process_name("us", "a") + "/runs/r1",)]
    got = inspect.events_in_context(log)
    assert [(name.rsplit("/", 1)[1], n) for name, n in rows(got, "event", "links")] == [("e1", 1), ("e2", 0)]


def test_readers_of_a_source(spark):
    log = lineage_log(
        spark,
        [process("us", "a", "origin-a", display="A"), process("us", "b", None)],
        events=[
            event("us", "a", "r", "e1", [("s", "t"), ("s", "u"), (None, "t")]),
            event("us", "b", "r", "e1", [("s", "t")]),
            event("us", "gone", "r", "e1", [("x", "s")]),
        ],
    )
    got = inspect.runs_by_source(log)
    assert [(r[0], r[1].split("/")[5], *r[2:]) for r in rows(
        got, "source_fqn", "run", "display_name", "origin_name")] == [
        ("s", "a", "A", "origin-a"), ("s", "b", "N/A", "N/A"), ("x", "gone", "N/A", "N/A"),
    ]
    gated = inspect.gated_runs_by_source(log)
    assert sorted(r.source_fqn for r in gated.collect()) == ["s", "s"]


def test_report_on_some_tables(spark):
    log = lineage_log(
        spark,
        events=[
            event("us", "a", "r", "e1", [("gcs:x", "bigquery:p.d.t")]),
            event("us", "a", "r", "e2", [("bigquery:p.d.t", "bigquery:p.d.u")]),
            event("us", "a", "r", "e3", [("bigquery:p.d.u", "custom:n.x")]),
        ],
    )
    asked = spark.createDataFrame([("p.d.t",), ("gcs:x",)], "identifier string")
    got = inspect.gated_runs_by_source(log, asked)
    assert rows(got, "source_fqn") == [("bigquery:p.d.t",)]  # gcs:x is only read
    targets = spark.createDataFrame([("bigquery:p.d.u",)], "target_fqn string")
    assert rows(links.upstream_links(log.links, targets), "source_fqn", "links") == [("bigquery:p.d.t", 1)]


def test_run_details(spark):
    log = lineage_log(
        spark,
        runs=[run("us", "a", "r1", "FAILED"), run("us", "a", "quiet")],
        events=[event("us", "a", name, "e", []) for name in ("r1", "r2")],
    )
    got = rows(inspect.run_details(log), "run", "state", "end_time")
    base = process_name("us", "a") + "/runs/"
    assert got == [(base + "r1", "FAILED", NOON), (base + "r2", None, None)]
