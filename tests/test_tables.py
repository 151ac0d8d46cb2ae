"""Stamps, sinks, DDL and pipelines."""

from __future__ import annotations

import uuid
from datetime import datetime
from pathlib import Path
from unittest.mock import Mock

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, WriterCommitMessage
from records import rows

from tracewell.operators.identity import process_identity
from tracewell.operators.links import edges_first_seen
from tracewell.operators.stamp import stamp, stamp_ingestion, stamp_pipeline, stamp_step
from tracewell.plans import pipelines
from tracewell.sources import tables
from tracewell.sources.log import create_log, read_log

NOON = datetime(2026, 1, 1, 12)
PEOPLE = [(1, "Ann", "crm"), (2, "Ben", "crm")]
SCHEMA = "id long, name string, source_system string"


@pytest.fixture()
def people(spark):
    return spark.createDataFrame(PEOPLE, SCHEMA)


@pytest.fixture()
def source(people, path):
    people.write.parquet(path("source"))
    return path("source")


@pytest.fixture()
def namespace(spark, path):
    name = "ns_" + uuid.uuid4().hex
    tables.ensure_namespace(spark, name, path("warehouse"), {"region": "us-east1"})
    yield name
    spark.sql(f"DROP DATABASE {name} CASCADE")


def test_stamp_keeps_rows_and_takes_one_clock(people):
    stamped = stamp_pipeline(people, "p1")
    assert stamped.columns == ["id", "name", "source_system", "processed_timestamp", "pipeline_id"]
    got = stamped.collect()
    assert len(got) == 2
    assert len({row.processed_timestamp for row in got}) == 1
    assert {row.pipeline_id for row in got} == {"p1"}


def test_stamping_again_replaces_the_stamp(people):
    twice = stamp_pipeline(stamp_pipeline(people, "p1", NOON), "p2", datetime(2026, 1, 2))
    assert twice.columns.count("pipeline_id") == 1
    assert rows(twice, "pipeline_id", "processed_timestamp") == [("p2", datetime(2026, 1, 2))] * 2


def test_steps_of_a_chain_keep_each_others_columns(people):
    both = stamp_step(stamp_ingestion(people, "one", NOON), "two", NOON)
    assert both.columns[3:] == [
        "ingestion_timestamp", "pipeline_id", "processing_timestamp", "processing_step",
    ]


def test_stamp_is_one_projection(people):
    plan = stamp(people, "t", {"a": "x", "b": "y"}, NOON)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Project") <= 1


def test_overwrite_removes_placeholder_files(spark, source, path):
    Path(path("dest")).mkdir()
    spark.createDataFrame([(0, "dummy")], "id long, name string").write.parquet(path("dest") + "/x")
    pipelines.files_to_files(spark, source, path("dest"), "p1", NOON)
    pipelines.files_to_files(spark, source, path("dest"), "p2", NOON)
    got = spark.read.parquet(path("dest"))
    assert rows(got, "id", "pipeline_id") == [(1, "p2"), (2, "p2")]


def test_a_directory_is_not_overwritten_by_what_reads_it(spark, source):
    for spelled in (source, source + "/", f"file://{source}"):
        with pytest.raises(ValueError, match="cannot overwrite"):
            tables.overwrite_dir(stamp_pipeline(tables.read_dir(spark, source), "p"), spelled)
    assert tables.read_dir(spark, source).count() == 2
    tables.overwrite_dir(tables.read_dir(spark, source), source + "2")


def test_load_job_truncates(spark, source, namespace):
    for _ in range(2):
        tables.load_table(spark, source, f"{namespace}.loaded")
    assert tables.read_table(spark, f"{namespace}.loaded").count() == 2


def test_external_table_sees_what_its_files_hold(spark, source, namespace, path):
    stamped = stamp_pipeline(spark.createDataFrame([(0, "dummy", "dummy")], SCHEMA), "dummy", NOON)
    stamped.write.parquet(path("dest"))
    tables.register_external(spark, f"{namespace}.src", source)
    tables.register_external(spark, f"{namespace}.dst", path("dest"))
    assert tables.table_location(spark, f"{namespace}.dst").endswith("/dest")
    pipelines.external_to_external(spark, f"{namespace}.src", f"{namespace}.dst", "p2", NOON)
    got = tables.read_table(spark, f"{namespace}.dst")
    assert rows(got, "id", "pipeline_id") == [(1, "p2"), (2, "p2")]


def test_a_column_may_be_called_location(spark, namespace, path):
    placed = spark.createDataFrame([(1, "here's")], "id long, Location string")
    placed.write.parquet(path("it's here"))
    tables.register_external(spark, f"{namespace}.placed", path("it's here"))
    assert tables.table_location(spark, f"{namespace}.placed").endswith("/it's here")
    tables.overwrite_external(spark.createDataFrame([(2, "there")], "id long, Location string"), f"{namespace}.placed")
    assert rows(spark.table(f"{namespace}.placed"), "id", "Location") == [(2, "there")]


def test_table_to_suffixed_table(spark, source, namespace):
    tables.load_table(spark, source, f"{namespace}.src")
    name = pipelines.table_to_table(
        spark, f"{namespace}.src", f"{namespace}.dst", "p6", NOON, suffix="_v2"
    )
    assert name == f"{namespace}.dst_v2"
    assert spark.table(name).count() == 2
    assert not spark.catalog.tableExists(f"{namespace}.dst")


def test_append_matches_columns_by_name(spark, people, namespace):
    tables.ensure_table(people, f"{namespace}.t")
    tables.append_table(people.select("source_system", "name", "id"), f"{namespace}.t")
    assert rows(spark.table(f"{namespace}.t"), "id", "name", "source_system") == PEOPLE


def test_an_existing_table_keeps_its_schema(spark, people, namespace):
    tables.ensure_table(people, f"{namespace}.t")
    tables.ensure_table(people.withColumn("extra", F.lit(1)), f"{namespace}.t")
    assert spark.table(f"{namespace}.t").columns == people.columns


def test_namespace_properties_and_location(spark, namespace, path):
    described = {
        row[0]: row[1] for row in spark.sql(f"DESCRIBE NAMESPACE EXTENDED {namespace}").collect()
    }
    assert described["Location"].endswith("/warehouse")
    assert "(region,us-east1)" in described["Properties"]


def test_which_tables_are_of_the_session_catalog(spark):
    assert tables._is_session_table(spark, "ns.t")
    assert tables._is_session_table(spark, "`spark_catalog`.`ns`.t")
    assert not tables._is_session_table(spark, "`lake`.`ns`.t")


def test_a_v2_table_is_appended_to_with_write_to(monkeypatch):
    monkeypatch.setattr(tables, "_is_session_table", lambda spark, name: False)
    df = Mock()
    tables.append_table(df, "`lake`.`ns`.t")
    df.writeTo.assert_called_once_with("`lake`.`ns`.t")
    df.writeTo.return_value.append.assert_called_once_with()


def chain(namespace, path):
    return pipelines.Chain("spark_catalog", namespace, path("warehouse"), "t1", "t2", "step_1", "step_2")


@pytest.mark.parametrize("runs", [1, 2, 3])
def test_growth_of_the_two_step_chain(spark, source, namespace, path, runs):
    names = chain(namespace, path)
    for _ in range(runs):
        assert pipelines.two_step(spark, source, names) is None
    assert spark.table(f"{namespace}.t1").count() == 2 * runs
    assert spark.table(f"{namespace}.t2").count() == 2 * runs * (runs + 1) // 2
    assert spark.table(f"{namespace}.t2").columns == [
        "id", "name", "source_system", "ingestion_timestamp", "pipeline_id",
        "processing_timestamp", "processing_step",
    ]


def test_incremental_chain_takes_each_row_once(spark, source, namespace, path):
    for _ in range(3):
        pipelines.two_step(spark, source, chain(namespace, path), incremental=True)
    assert spark.table(f"{namespace}.t1").count() == 6
    assert spark.table(f"{namespace}.t2").count() == 6


def test_incremental_chain_takes_a_clock_of_spark(spark, source, namespace, path):
    for _ in range(2):
        pipelines.two_step(
            spark, source, chain(namespace, path), as_of=F.current_timestamp(), incremental=True
        )
    assert spark.table(f"{namespace}.t2").count() == spark.table(f"{namespace}.t1").count() == 4


def test_chain_declares_table_and_column_lineage(spark, source, namespace, path):
    create_log(spark, path("log"))
    job = pipelines.Job("proj", "job_5", "Chain job", "Chain run", path("log"))
    outcome = pipelines.two_step(spark, source, chain(namespace, path), job)
    assert outcome.ok
    log = read_log(spark, path("log"))
    one, two = f"bigquery:proj.{namespace}.t1", f"bigquery:proj.{namespace}.t2"
    got = log.links.select("source", "target", "level")
    first = "gcs:" + source.rstrip("/").replace("/", ".")
    assert rows(got, "source", "target", "level") == sorted(
        [
            (first, one, "table"),
            (one, two, "table"),
            (f"{one}.pipeline_id", f"{two}.processing_step", "column"),
        ],
        key=repr,
    )
    assert log.events.count() == 3
    process = log.processes.first()
    assert process.attributes == {"custom_job_id": "job_5", "spark.app.name": spark.conf.get("spark.app.name")}
    assert process.origin.asDict() == {"source_type": "CUSTOM", "name": "projects/proj/locations/us-east1"}
    run = log.runs.first()
    assert run.state == "COMPLETED" and run.start_time == run.end_time
    assert run.name.startswith(process.name + "/runs/")


def test_four_runs_under_three_identities(spark, source, namespace, path):
    create_log(spark, path("log"))
    tables.load_table(spark, source, f"{namespace}.src")
    app = spark.conf.get("spark.app.name")
    phases = [
        ("_baseline", {}),
        ("_baseline", {}),
        ("_v2", {"spark.openlineage.appName": "other"}),
        ("_explicit", {"spark.openlineage.namespace": "own", "spark.openlineage.appName": "explicit"}),
    ]
    for suffix, settings in phases:
        job = pipelines.Job("proj", "job_6", "Unique job", "Unique run", path("log"))
        for key, value in settings.items():
            spark.conf.set(key, value)
        outcome = pipelines.table_with_lineage(
            spark, f"{namespace}.src", f"{namespace}.dst", "p6", job, NOON, suffix
        )
        for key in settings:
            spark.conf.unset(key)
        assert outcome.ok
    log = read_log(spark, path("log"))
    assert log.processes.count() == 4
    got = process_identity(log)
    assert rows(got, "namespace", "app_name", "processes") == sorted(
        [("default", app, 2), ("default", "other", 1), ("own", "explicit", 1)], key=repr
    )
    edges = edges_first_seen(log.links)
    base = f"bigquery:proj.{namespace}"
    assert rows(edges, "source_fqn", "target_fqn") == [
        (f"{base}.src", f"{base}.dst{suffix}") for suffix in ("_baseline", "_explicit", "_v2")
    ]


KIND = pipelines.EntryKind("entry-type", "aspect", "aspect-type")


def test_files_with_registered_lineage(spark, source, path):
    create_log(spark, path("log"))
    job = pipelines.Job("proj", "job_4", "Copy job", "Copy run", path("log"))
    for _ in range(2):
        outcome = pipelines.files_with_lineage(spark, source, path("dest"), "p4", job, "ns", KIND, NOON)
        assert outcome.ok
    log = read_log(spark, path("log"))
    assert spark.read.parquet(path("dest")).count() == 2
    assert log.entries.count() == 2  # got or created
    assert log.processes.count() == 2  # posted each time
    links = log.links.select("source", "target").distinct()
    registered = [row.fqn for row in log.entries.orderBy("fqn").collect()]
    assert sorted(links.first()) == registered
    aspect = log.entries.where("entry_id = 'job_4-source'").first().aspects["aspect"]
    assert aspect.data.asDict() == {"format": "parquet", "framework": "TYDA", "path": source}


def test_failed_lineage_leaves_the_data(spark, source, path):
    blocked = Path(path("blocked"))
    blocked.write_text("a file where the log should be")
    job = pipelines.Job("proj", "job_4", "Copy job", "Copy run", str(blocked))
    outcome = pipelines.files_with_lineage(spark, source, path("dest"), "p4", job, "ns", KIND, NOON)
    assert not outcome.ok and outcome.error
    assert spark.read.parquet(path("dest")).count() == 2


def folder_tables():
    """An external connector: tables are files of JSON rows, written via staging.

    Defined in a function so that it travels to the Python workers by value.
    """

    class FolderTables(DataSource):
        @classmethod
        def name(cls):
            return "foldertables"

        def schema(self):
            return "id long, name string"

        def reader(self, schema):
            return FolderReader(self.options["table"])

        def writer(self, schema, overwrite):
            return FolderWriter(self.options["table"], self.options["staging"], overwrite)

    class FolderReader(DataSourceReader):
        def __init__(self, table):
            self.table = table

        def read(self, partition):
            import json

            for line in Path(self.table).read_text().splitlines():
                yield tuple(json.loads(line))

    class FolderWriter(DataSourceWriter):
        def __init__(self, table, staging, overwrite):
            self.table, self.staging, self.overwrite = table, staging, overwrite

        def write(self, iterator):
            import json
            import uuid

            part = Path(self.staging) / uuid.uuid4().hex
            part.write_text("\n".join(json.dumps([row.id, row.pipeline_id]) for row in iterator))
            return WriterCommitMessage()

        def commit(self, messages):
            assert self.overwrite
            parts = [part.read_text() for part in Path(self.staging).iterdir()]
            Path(self.table).write_text("\n".join(part for part in parts if part))

    return FolderTables


def test_tables_of_an_external_connector(spark, path):
    spark.dataSource.register(folder_tables())
    Path(path("in")).write_text('[1, "a"]\n[2, "b"]')
    Path(path("staging")).mkdir()
    pipelines.table_to_table(
        spark, path("in"), path("out"), "p0", NOON, connector="foldertables", staging=path("staging")
    )
    got = tables.read_table(spark, path("out"), "foldertables")
    assert rows(got, "id", "name") == [(1, "p0"), (2, "p0")]


def test_runs_by_id_replace_themselves(spark, source, namespace, path):
    steps, count = chain(namespace, path), tables.read_dir(spark, source).count()
    as_of = F.lit("2026-01-01 00:00:00").cast("timestamp_ntz")

    def counts(name):
        rows = spark.table(steps.table(name)).groupBy("run_id").count().collect()
        return {row.run_id: row["count"] for row in rows}

    # One clock for all runs, and each run given twice.
    for run in ("a", "b", "a", "b"):
        pipelines.two_step(spark, source, steps, as_of=as_of, run_id=run)
    assert counts(steps.table_1) == counts(steps.table_2) == {"a": count, "b": count}
    assert "processing_step" in spark.table(steps.table(steps.table_2)).columns
    one = spark.table(steps.table(steps.table_1)).where("run_id = 'a'")
    plan = one._jdf.queryExecution().optimizedPlan().toString()
    # The condition is met by the choice of files alone.
    assert one.count() == count and "Filter" not in one._jdf.queryExecution().executedPlan().toString().split("FileScan")[0], plan
    with pytest.raises(ValueError):
        pipelines.two_step(spark, source, steps, run_id="c", incremental=True)
