from __future__ import annotations

import hashlib

from pyspark.sql import functions as F
from records import NOON, entry, rows

from tracewell.operators import record
from tracewell.operators.links import declared_links
from tracewell.sources.log import ENTRY_SCHEMA

LINKS = "event string, start_time timestamp_ntz, location string, link_pos int, " \
        "source_fqn string, target_fqn string, level string"


def link_rows(spark, count, event="e"):
    data = [(event, NOON, "us", i, f"s{i}", f"t{i}", "table") for i in range(count)]
    return spark.createDataFrame(data, LINKS)


def test_an_event_keeps_its_links_and_positions_at_any_size(spark):
    rows_ = link_rows(spark, 250).withColumn("link_pos", F.col("link_pos") * 3)
    other = link_rows(spark, 1, "e-1").withColumn("link_pos", F.lit(7))
    events, links = record.events_from_links(rows_.unionAll(other))
    assert rows(events, "name") == [("e",), ("e-1",)]
    got = declared_links(links)
    assert rows(got.where("event = 'e-1'"), "link_pos") == [(7,)]
    assert {row.link_pos for row in got.where("event = 'e'").collect()} == {3 * i for i in range(250)}


def test_repeated_delivery_counts_once(spark):
    once = link_rows(spark, 120)
    events, links = record.events_from_links(once.unionAll(once))
    assert (events.count(), links.count()) == (1, 120)


def test_an_event_keeps_its_end(spark):
    later = NOON.replace(hour=14)
    events, _ = record.events_from_links(link_rows(spark, 2).withColumn("end_time", F.lit(later).cast("timestamp_ntz")))
    assert rows(events, "end_time") == [(later,)]


def test_links_without_endpoints_are_kept(spark):
    missing = spark.createDataFrame([("e", NOON, "us", 0, None, "t", "table")], LINKS)
    assert rows(declared_links(record.events_from_links(missing)[1]), "source_fqn") == [(None,)]


def jobs(spark, *rows):
    return spark.createDataFrame(list(rows), record.JOB_SCHEMA)


def event_of(run, source, target, level="table"):
    return f"{run}/lineageEvents/{hashlib.md5(chr(10).join([level, source, target]).encode()).hexdigest()}"


def test_one_event_per_declared_link(spark):
    job = ("p", "us", "j", "Job", "Run", NOON, [("a", "b", "table"), ("a.x", "b.y", "column")])
    df = jobs(spark, job)
    run = record.run_records(df).first().name
    expected = sorted([(event_of(run, "a", "b"), 0, "a"), (event_of(run, "a.x", "b.y", "column"), 0, "a.x")])
    assert rows(record.event_records(df), "name") == [(event,) for event, *_ in expected]
    assert rows(record.link_records(df), "event", "link_pos", "source") == expected


def test_a_run_delivered_in_parts_keeps_all_links(spark):
    head = ("p", "us", "j", "Job", "Run", NOON)
    parts = jobs(
        spark,
        (*head, [("a", "b", "table")]),
        (*head, [("c", "d", "table"), ("a", "b", "table")]),
        (*head, [("c", "d", "table")]),
        (*head, [(None, "d", "table")]),
    )
    assert rows(record.link_records(parts), "source", "target") == [("a", "b"), ("c", "d"), (None, "d")]
    assert record.event_records(parts).count() == 3
    one_by_one = [record.link_records(parts.limit(n)).select("event") for n in (1, 2, 4)]
    assert one_by_one[0].exceptAll(one_by_one[1]).isEmpty() and one_by_one[1].exceptAll(one_by_one[2]).isEmpty()


def test_two_runs_of_a_job_at_one_time_are_one_process(spark):
    both = jobs(
        spark,
        ("p", "us", "j", "Job", "Run 1", NOON, [("a", "b", "table")]),
        ("p", "us", "j", "Job", "Run 2", NOON, [("a", "b", "table")]),
    )
    twice = both.unionAll(both)
    assert record.process_records(twice).count() == 1
    assert record.run_records(twice).count() == 2
    assert record.event_records(twice).count() == record.link_records(twice).count() == 2


def test_the_same_job_at_another_time_is_another_process(spark):
    first = ("p", "us", "j", "Job", "Run", NOON, None)
    later = ("p", "us", "j", "Job", "Run", NOON.replace(hour=13), None)
    names = record.process_records(jobs(spark, first, later))
    assert names.select("name").distinct().count() == 2
    assert record.event_records(jobs(spark, first)).count() == 0


def test_existing_entries_are_left_alone(spark):
    wanted = spark.createDataFrame(
        [entry("a", "new:a"), entry("b", "new:b2"), entry("b", "new:b1")], ENTRY_SCHEMA
    )
    existing = spark.createDataFrame([entry("a", "old:a"), entry("c", "old:c")], ENTRY_SCHEMA)
    assert rows(record.missing_entries(wanted, existing), "entry_id", "fqn") == [("b", "new:b1")]


def test_an_entry_without_a_name_is_created_too(spark):
    wanted = spark.createDataFrame([entry("a", None)], ENTRY_SCHEMA)
    existing = spark.createDataFrame([], ENTRY_SCHEMA)
    assert rows(record.missing_entries(wanted, existing), "entry_id", "fqn") == [("a", None)]


def test_entry_of_a_path(spark):
    paths = spark.createDataFrame(
        [("i", "ns", "gs://b/source/", "Source")],
        "entry_id string, namespace string, path string, display_name string",
    )
    got = record.entry_records(paths, "type", "aspect", "aspect-type").first()
    assert got.fqn == "custom:ns.b.source"
    assert got.entry_source.asDict() == {
        "resource": "//storage.googleapis.com/b/source", "system": "cloud_storage", "display_name": "Source",
    }
    assert got.aspects["aspect"].data.path == "gs://b/source/"


def test_best_effort_reports_the_failure():
    def fail():
        raise RuntimeError("no service")

    assert record.best_effort(fail) == record.Emission(False, "no service")
    assert record.best_effort(lambda: None).ok
