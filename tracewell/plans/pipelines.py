"""Pipelines a user runs: read, stamp, write, and where asked record lineage."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell import fixed_values as V
from tracewell.functions import column_fqn, custom_fqn, gcs_fqn, table_fqn
from tracewell.operators import record
from tracewell.operators.identity import session_properties
from tracewell.operators.record import Emission
from tracewell.operators.stamp import stamp_ingestion, stamp_pipeline, stamp_step
from tracewell.sources import discovery, log, tables

Clock = datetime | Column | None


def table_to_table(
    spark: SparkSession,
    source: str,
    dest: str,
    pipeline_id: str,
    as_of: Clock = None,
    suffix: str = "",
    connector: str | None = None,
    **options: str,
) -> str:
    """Table, stamp, table; `suffix` keeps the outputs of several runs apart."""
    name = tables.suffixed(dest, suffix)
    stamped = stamp_pipeline(tables.read_table(spark, source, connector), pipeline_id, as_of)
    tables.overwrite_table(stamped, name, connector, **options)
    return name


def files_to_files(
    spark: SparkSession, source: str, dest: str, pipeline_id: str, as_of: Clock = None
) -> None:
    tables.overwrite_dir(stamp_pipeline(tables.read_dir(spark, source), pipeline_id, as_of), dest)


def external_to_external(
    spark: SparkSession, source: str, dest: str, pipeline_id: str, as_of: Clock = None
) -> None:
    """External table, stamp, external table; the output goes to the files of `dest`."""
    stamped = stamp_pipeline(tables.read_table(spark, source), pipeline_id, as_of)
    tables.overwrite_external(stamped, dest)


def discovered_to_files(
    spark: SparkSession, root: str, dataset: str, dest: str, pipeline_id: str, as_of: Clock = None
) -> None:
    """A dataset found below a storage root, stamp, files."""
    files_to_files(spark, discovery.dataset_location(spark, root, dataset), dest, pipeline_id, as_of)


def register_discovered(
    spark: SparkSession, root: str, store: str, namespace: str, log_root: str, kind: EntryKind
) -> discovery.Crawl:
    """Crawl a storage root and register what changed: external tables, and entries of datasets.

    Tables of changed datasets get the columns that their files have now, those of datasets
    that are gone are dropped; files are never touched. An entry that is there stays as it is.
    """
    found = discovery.crawl(spark, root, store)
    for dataset, location in found.changed:
        tables.replace_external(spark, f"{namespace}.`{dataset}`", location)
    for dataset, _ in found.removed:
        spark.sql(f"DROP TABLE IF EXISTS {namespace}.`{dataset}`")
    if found.changed:
        paths = [(f"{namespace}.{dataset}", namespace, location, dataset) for dataset, location in found.changed]
        schema = "entry_id string, namespace string, path string, display_name string"
        register_paths(spark.createDataFrame(paths, schema), kind, log_root)
    return found


@dataclass(frozen=True)
class Job:
    """What a pipeline says about itself in the lineage log."""

    project: str
    job_id: str
    job_name: str
    run_name: str
    log_root: str
    location: str = V.LOCATIONS[0]
    properties: Mapping[str, str] = field(default_factory=dict)


def _job_row(spark: SparkSession, job: Job, **paths: str) -> DataFrame:
    fixed = {
        "project": job.project,
        "location": job.location,
        "job_id": job.job_id,
        "job_name": job.job_name,
        "run_name": job.run_name,
        **paths,
    }
    # Without properties of its own a job runs under the identity of its session.
    properties = dict(job.properties or session_properties(spark))
    now = datetime.now(timezone.utc).replace(tzinfo=None)
    schema = ", ".join(f"{name} string" for name in fixed)
    schema += ", started_at timestamp_ntz, properties map<string,string>"
    return spark.createDataFrame([(*fixed.values(), now, properties)], schema)


def job_records(jobs: DataFrame) -> dict[str, DataFrame]:
    """Process, run, event and link records of jobs with declared links."""
    return {
        "processes": record.process_records(jobs),
        "runs": record.run_records(jobs),
        "events": record.event_records(jobs),
        "links": record.link_records(jobs),
    }


def append_jobs(jobs: DataFrame, log_root: str, token: str | None = None) -> int:
    """Append the records of jobs with declared links as one commit; a token counts once."""
    return log.append(log_root, job_records(jobs), token)


def copy_links(jobs: DataFrame) -> DataFrame:
    """Declare source_path to dest_path as registered names of `namespace`."""
    namespace = F.col("namespace")
    source = custom_fqn(namespace, F.col("source_path"))
    dest = custom_fqn(namespace, F.col("dest_path"))
    return jobs.withColumn("links", F.array(record.link(source, dest)))


def table_links(jobs: DataFrame) -> DataFrame:
    """Declare source_table to dest_table, both named `namespace.table`."""
    project = F.concat(F.lit(V.BIGQUERY), F.col("project"), F.lit("."))
    source = F.concat(project, F.col("source_table"))
    return jobs.withColumn("links", F.array(record.link(source, F.concat(project, F.col("dest_table")))))


def two_step_links(jobs: DataFrame) -> DataFrame:
    """Declare source_path to table_1 to table_2, and the column the second step adds.

    The column edge is a statement of the job, not read off a plan.
    """
    first = table_fqn(F.col("project"), F.col("namespace"), F.col("table_1"))
    second = table_fqn(F.col("project"), F.col("namespace"), F.col("table_2"))
    links = F.array(
        record.link(gcs_fqn(F.col("source_path")), first),
        record.link(first, second),
        record.link(
            column_fqn(first, F.lit("pipeline_id")),
            column_fqn(second, F.lit("processing_step")),
            V.COLUMN_LEVEL,
        ),
    )
    return jobs.withColumn("links", links)


@dataclass(frozen=True)
class EntryKind:
    """How the catalog entries of a pipeline's paths are typed."""

    entry_type: str
    aspect: str
    aspect_type: str


def path_entries(paths: DataFrame, kind: EntryKind) -> DataFrame:
    return record.entry_records(paths, kind.entry_type, kind.aspect, kind.aspect_type)


def register_paths(paths: DataFrame, kind: EntryKind, log_root: str, token: str | None = None) -> int:
    """Create catalog entries for paths that have none yet, whoever else registers at the same time."""
    return log.append(log_root, {"entries": path_entries(paths, kind)}, token)


def files_with_lineage(
    spark: SparkSession,
    source: str,
    dest: str,
    pipeline_id: str,
    job: Job,
    namespace: str,
    kind: EntryKind,
    as_of: Clock = None,
) -> Emission:
    """Files, stamp, files, then entries and a table-level link under registered names."""
    files_to_files(spark, source, dest, pipeline_id, as_of)

    def emit() -> None:
        entries = spark.createDataFrame(
            [
                (f"{job.job_id}-source", namespace, source, f"{job.job_name} source"),
                (f"{job.job_id}-dest", namespace, dest, f"{job.job_name} destination"),
            ],
            "entry_id string, namespace string, path string, display_name string",
        )
        row = _job_row(spark, job, namespace=namespace, source_path=source, dest_path=dest)
        log.append(job.log_root, {**job_records(copy_links(row)), "entries": path_entries(entries, kind)})

    return record.best_effort(emit)


def table_with_lineage(
    spark: SparkSession,
    source: str,
    dest: str,
    pipeline_id: str,
    job: Job,
    as_of: Clock = None,
    suffix: str = "",
) -> Emission:
    """Table, stamp, suffixed table, then a table-level link under the identity of the run.

    The identity is that of the job's properties, or else of the session.
    """
    name = table_to_table(spark, source, dest, pipeline_id, as_of, suffix)

    def emit() -> None:
        row = _job_row(spark, job, source_table=source, dest_table=name)
        append_jobs(table_links(row), job.log_root)

    return record.best_effort(emit)


@dataclass(frozen=True)
class Chain:
    """Names of a two-step chain in a catalog."""

    catalog: str
    namespace: str
    location: str
    table_1: str
    table_2: str
    pipeline_id: str
    step: str
    provider: str = "parquet"

    def namespace_name(self) -> str:
        return f"`{self.catalog}`.`{self.namespace}`"

    def table(self, name: str) -> str:
        return f"{self.namespace_name()}.{name}"


def two_step(
    spark: SparkSession,
    source: str,
    chain: Chain,
    job: Job | None = None,
    properties: dict[str, str] | None = None,
    as_of: Clock = None,
    incremental: bool = False,
    run_id: str | None = None,
) -> Emission | None:
    """Files to table 1, table 1 to table 2, then declared table and column lineage.

    Both steps append and the second reads all of table 1, so after k runs on
    N rows table 1 has k N rows and table 2 has N k (k + 1) / 2. With
    `incremental` the second step takes only the rows of this run, which must
    then have a time of its own.

    With a `run_id` both tables are partitioned by it. The second step reads the partition
    of this run only, and a run that is repeated replaces its own rows, so both tables have
    N rows per run, whatever the clock said.
    """
    if run_id is not None and incremental:
        raise ValueError("a run is told by its run_id or by its time, not by both")
    if incremental:
        as_of = _moment(spark, as_of)
    tables.ensure_namespace(spark, chain.namespace_name(), chain.location, properties)
    if run_id is not None:
        _two_steps_of_run(spark, source, chain, as_of, run_id)
        return None if job is None else _record_two_step(spark, source, chain, job)

    first = stamp_ingestion(tables.read_dir(spark, source), chain.pipeline_id, as_of)
    _create_and_append(first, chain.table(chain.table_1), chain.provider)

    ingested = tables.read_table(spark, chain.table(chain.table_1))
    if incremental:
        ingested = ingested.where(F.col("ingestion_timestamp") == F.lit(as_of))
    second = stamp_step(ingested, chain.step, as_of)
    _create_and_append(second, chain.table(chain.table_2), chain.provider)

    return None if job is None else _record_two_step(spark, source, chain, job)


def _record_two_step(spark: SparkSession, source: str, chain: Chain, job: Job) -> Emission:
    def emit() -> None:
        row = _job_row(
            spark,
            job,
            source_path=source,
            namespace=chain.namespace,
            table_1=chain.table_1,
            table_2=chain.table_2,
        )
        append_jobs(two_step_links(row), job.log_root)

    return record.best_effort(emit)


RUN_ID = "run_id"


def _two_steps_of_run(spark: SparkSession, source: str, chain: Chain, as_of: Clock, run_id: str) -> None:
    first = stamp_ingestion(tables.read_dir(spark, source), chain.pipeline_id, as_of)
    first = first.withColumn(RUN_ID, F.lit(run_id))
    tables.ensure_table(first, chain.table(chain.table_1), chain.provider, RUN_ID)
    tables.replace_partition(first, chain.table(chain.table_1), RUN_ID, run_id)

    ingested = tables.read_table(spark, chain.table(chain.table_1)).where(F.col(RUN_ID) == run_id)
    second = stamp_step(ingested, chain.step, as_of)
    tables.ensure_table(second, chain.table(chain.table_2), chain.provider, RUN_ID)
    tables.replace_partition(second, chain.table(chain.table_2), RUN_ID, run_id)


def _moment(spark: SparkSession, clock: Clock) -> datetime:
    """One time for both steps, whatever the clock would say later."""
    if isinstance(clock, Column):
        return spark.range(1).select(clock).first()[0]
    return clock or datetime.now(timezone.utc)


def _create_and_append(df: DataFrame, name: str, provider: str) -> None:
    tables.ensure_table(df, name, provider)
    tables.append_table(df, name)
