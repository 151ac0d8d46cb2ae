"""One query per operator, on the benchmark tables or the log derived from them."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell import fixed_values as V
from tracewell.functions import (
    column_fqn,
    custom_fqn,
    fqn_to_path,
    gcs_fqn,
    json_field,
    normalise_identifier,
    process_of,
    run_of,
    strip_slash,
    system_resource,
    table_fqn,
)
from tracewell.operators import audit, cycles, graph, identity, inspect, links, record
from tracewell.operators.stamp import stamp_pipeline
from tracewell.plans import pipelines, standing
from tracewell.sources import commits, discovery, tables
from tracewell.sources.log import LineageLog, append, append_records, compact, create_log, read_log
from tracewell.sources.paged import load_paged_log
from tracewell.sources.workspace import fresh_path
from tracewell.workload.derived_log import PROJECT, batches, dataset_fqn, stored_log, stored_root, table
from tracewell.workload.paged_export import write_export

Query = Callable[[SparkSession, str], DataFrame]

PURGED = [V.LOCATIONS[0]]


def moment(day: int) -> Column:
    """A fixed clock, so that results can be compared."""
    return F.lit(f"2026-01-{day:02d} 00:00:00").cast("timestamp_ntz")


def fresh_namespace(spark: SparkSession) -> tuple[str, str]:
    """A namespace of this run, with its tables below the shared folder."""
    location = fresh_path(spark, "tables")
    name = "run_" + location.rsplit("-", 1)[1]
    tables.ensure_namespace(spark, name, location)
    return name, location


# Stamps, sinks and pipelines


def stamp_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stamp_pipeline(tables.read_dir(spark, f"{sf_dir}/orders.parquet"), "stamp_orders", moment(1))


def overwrite_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    dest = fresh_path(spark, "files")
    for run in ("first", "second"):
        pipelines.files_to_files(spark, f"{sf_dir}/customer.parquet", dest, run, moment(1))
    return tables.read_dir(spark, dest)


def external_table_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    namespace, location = fresh_namespace(spark)
    source, dest = f"{namespace}.source", f"{namespace}.dest"
    tables.register_external(spark, source, f"{sf_dir}/supplier.parquet")
    earlier = stamp_pipeline(tables.read_table(spark, source), "placeholder", moment(1))
    tables.overwrite_dir(earlier, f"{location}-dest")
    tables.register_external(spark, dest, f"{location}-dest")
    pipelines.external_to_external(spark, source, dest, "external", moment(2))
    return tables.read_table(spark, dest)


def table_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    namespace, _ = fresh_namespace(spark)
    source = f"{namespace}.source"
    tables.load_table(spark, f"{sf_dir}/part.parquet", source)
    tables.load_table(spark, f"{sf_dir}/part.parquet", source)
    return tables.read_table(
        spark, pipelines.table_to_table(spark, source, f"{namespace}.dest", "table", moment(1))
    )


def discovered_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    dest = fresh_path(spark, "files")
    pipelines.discovered_to_files(spark, sf_dir, "conversations", dest, "discovered", moment(1))
    return tables.read_dir(spark, dest)


def suffixed_destinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    namespace, _ = fresh_namespace(spark)
    source, dest = f"{namespace}.source", f"{namespace}.dest"
    tables.register_external(spark, source, f"{sf_dir}/supplier.parquet")
    outputs = {
        suffix: pipelines.table_to_table(spark, source, dest, "suffixed", moment(1), suffix)
        for suffix in ("_baseline", "_baseline", "_v2", "_explicit")
    }
    first, *rest = [
        tables.read_table(spark, name).withColumn("suffix", F.lit(suffix))
        for suffix, name in outputs.items()
    ]
    for other in rest:
        first = first.unionByName(other)
    return first


def _two_steps(spark: SparkSession, sf_dir: str, incremental: bool) -> DataFrame:
    location = fresh_path(spark, "chain")
    namespace = "chain_" + location.rsplit("-", 1)[1]
    chain = pipelines.Chain(
        tables.SESSION_CATALOG, namespace, location, "step_1", "step_2", "chain_step_1", "chain_step_2"
    )
    for day in (1, 2, 3):
        pipelines.two_step(
            spark,
            f"{sf_dir}/customer.parquet",
            chain,
            properties={"region": V.LOCATIONS[0]},
            as_of=moment(day),
            incremental=incremental,
        )
    return tables.read_table(spark, chain.table(chain.table_2))


def two_step_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _two_steps(spark, sf_dir, incremental=False)


def two_step_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _two_steps(spark, sf_dir, incremental=True)


def two_step_by_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three runs, two of them with one clock, one of them repeated with another clock."""
    location = fresh_path(spark, "chain")
    namespace = "chain_" + location.rsplit("-", 1)[1]
    chain = pipelines.Chain(
        tables.SESSION_CATALOG, namespace, location, "step_1", "step_2", "chain_step_1", "chain_step_2"
    )
    for run, day in (("a", 1), ("b", 1), ("c", 2), ("b", 3)):
        pipelines.two_step(spark, f"{sf_dir}/customer.parquet", chain, as_of=moment(day), run_id=run)
    return tables.read_table(spark, chain.table(chain.table_2))


# Pipelines with their lineage


def _with_log(rows: DataFrame, log: LineageLog) -> DataFrame:
    """Rows that a pipeline wrote, beside what the log says of it."""
    counts = [
        records.agg(F.count(F.lit(1)).alias(name))
        for name, records in (
            ("processes", log.processes), ("runs", log.runs), ("events", log.events), ("entries", log.entries)
        )
    ]
    edges = links.table_edges(log.links).agg(F.count(F.lit(1)).alias("edges"))
    for one in (*counts, edges):
        rows = rows.withColumn(one.columns[0], one.scalar())
    return rows


def _job(spark: SparkSession, name: str, **properties: str) -> pipelines.Job:
    root = fresh_path(spark, "job-log")
    create_log(spark, root)
    return pipelines.Job(PROJECT, name, name, "run", root, properties=properties)


KIND = pipelines.EntryKind("copy-entry", "copy-aspect", "copy-aspect-type")


def files_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files to files with registered ends and a declared link, run twice."""
    dest, job = fresh_path(spark, "files"), _job(spark, "copy")
    for run in ("first", "second"):
        done = pipelines.files_with_lineage(
            spark, f"{sf_dir}/customer.parquet", dest, run, job, "demo", KIND, moment(1)
        )
        if not done.ok:
            raise RuntimeError(done.error)
    return _with_log(tables.read_dir(spark, dest), read_log(spark, job.log_root))


def table_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table to suffixed tables under several identities; each row with the identity of its run."""
    namespace, _ = fresh_namespace(spark)
    tables.register_external(spark, f"{namespace}.source", f"{sf_dir}/supplier.parquet")
    root = _job(spark, "suffixed").log_root
    for number, (suffix, app) in enumerate((("_baseline", "app"), ("_baseline", "app"), ("_v2", "other"))):
        job = pipelines.Job(
            PROJECT, f"suffixed-{number}", "Suffixed", "run", root, properties={V.APP_NAME_PROPERTY: app}
        )
        done = pipelines.table_with_lineage(
            spark, f"{namespace}.source", f"{namespace}.dest", "suffixed", job, moment(1), suffix
        )
        if not done.ok:
            raise RuntimeError(done.error)
    written = [
        tables.read_table(spark, f"{namespace}.dest{suffix}").withColumn("app_name", F.lit(app))
        for suffix, app in (("_baseline", "app"), ("_v2", "other"))
    ]
    found = identity.process_identity(read_log(spark, root)).select("app_name", "namespace", "processes", "runs")
    return written[0].unionByName(written[1]).join(found, "app_name")


def failed_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log cannot be written; the data stands and the failure is told."""
    dest = fresh_path(spark, "files")
    job = pipelines.Job(PROJECT, "copy", "copy", "run", "nowhere://log")
    done = pipelines.files_with_lineage(
        spark, f"{sf_dir}/customer.parquet", dest, "copy", job, "demo", KIND, moment(1)
    )
    return tables.read_dir(spark, dest).withColumn("recorded", F.lit(done.ok))


def discover_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.discover(spark, sf_dir).select("dataset", "files", "bytes")


def discover_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.discover_columns(spark, sf_dir)


# Names and payloads


def _page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit(V.STORAGE_URI), F.regexp_replace("url", "^https?://", ""))
    return table(spark, sf_dir, "pages").select("page_id", path.alias("path"))


def fqn_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("path")
    page = F.col("page_id").cast("string")
    endings = F.array(F.lit(""), F.lit("/"), F.lit("//"))
    paths = _page_paths(spark, sf_dir).select("page_id", path.alias("bare"), F.explode(endings).alias("ending"))
    return paths.withColumn("path", F.concat("bare", "ending")).select(
        "page_id",
        "path",
        strip_slash(path).alias("stripped"),
        gcs_fqn(path).alias("gcs"),
        custom_fqn(F.lit("demo"), path).alias("custom"),
        system_resource(path).alias("resource"),
        table_fqn(F.lit("demo"), F.lit("pages"), page).alias("table_name"),
        column_fqn(gcs_fqn(path), F.lit("html")).alias("column_name"),
        normalise_identifier(path).alias("plain_identifier"),
        normalise_identifier(gcs_fqn(path)).alias("fqn_identifier"),
    )


def fqn_to_path_of_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = links.flatten_links(stored_log(spark, sf_dir).links)
    fqns = names.select(F.explode(F.array("source_fqn", "target_fqn")).alias("fqn")).distinct()
    return fqns.withColumn("path", fqn_to_path(F.col("fqn")))


def record_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    event = F.col("name")
    return stored_log(spark, sf_dir).events.select(
        event.alias("event"), run_of(event).alias("run"), process_of(event).alias("process")
    )


def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    props = F.col("props")
    return table(spark, sf_dir, "events").select(
        "event_id", json_field(props, "k").alias("k"), json_field(props, "name").alias("name")
    )


# Recording


def emit_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link rows to event and link records, appended to a new log, read back as link rows."""
    log = stored_log(spark, sf_dir)
    ends = _ends(log)
    how = links.dealing(ends, log.links)
    declared = links.declared_links(log.links, "start_time", "location")
    emitted = _emitted(spark, *links.with_ends(declared, ends, how))
    found = links.with_ends(links.declared_links(emitted.links), _ends(emitted), how)
    return reduce(DataFrame.unionByName, [part.drop("dealt") for part in found])


def _ends(log: LineageLog) -> DataFrame:
    return log.events.select(F.col("name").alias("event"), "end_time")


def _emitted(spark: SparkSession, *parts: DataFrame) -> LineageLog:
    """The log of link rows; no event is in two parts."""
    root = fresh_path(spark, "emitted")
    create_log(spark, root)
    records = [record.events_from_links(rows) for rows in parts]
    events, declared = (reduce(DataFrame.unionByName, kind) for kind in zip(*records, strict=True))
    append(root, {"events": events, "links": declared})
    return read_log(spark, root)


def large_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One event per supplier with a link per line, at positions with gaps; what is read back of each."""
    supplier = F.col("l_suppkey").cast("string")
    rows = table(spark, sf_dir, "lineitem").select(
        F.concat(
            F.lit(f"projects/{PROJECT}/locations/us/processes/supply/runs/r"), supplier, F.lit("/lineageEvents/e")
        ).alias("event"),
        moment(1).alias("start_time"),
        moment(2).alias("end_time"),
        F.lit("us").alias("location"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("int").alias("link_pos"),
        dataset_fqn(F.col("l_partkey")).alias("source_fqn"),
        dataset_fqn(F.col("l_suppkey")).alias("target_fqn"),
        F.lit(V.TABLE_LEVEL).alias("level"),
    )
    log = _emitted(spark, rows)
    found = log.links.groupBy("event").agg(
        F.count(F.lit(1)).alias("links"),
        F.min("link_pos").alias("first_pos"),
        F.max("link_pos").alias("last_pos"),
        F.sum("link_pos").alias("sum_pos"),
    )
    reads = inspect.events_by_source(log.links).groupBy("event").agg(F.count(F.lit(1)).alias("sources"))
    events = log.events.groupBy(F.col("name").alias("event")).agg(
        F.count(F.lit(1)).alias("records"), F.max("end_time").alias("end_time")
    )
    return events.join(found, "event").join(reads, "event")


def _page_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page as the input of a job of its own."""
    page = F.col("page_id").cast("string")
    return _page_paths(spark, sf_dir).select(
        F.lit("demo").alias("project"),
        F.lit(V.LOCATIONS[0]).alias("location"),
        F.concat(F.lit("page-"), page).alias("job_id"),
        F.lit("Page job").alias("job_name"),
        F.lit("Page run").alias("run_name"),
        moment(1).alias("started_at"),
        F.lit("pages").alias("namespace"),
        F.col("path").alias("source_path"),
        F.concat(F.lit("gs://dest/pages/"), page, F.lit("/")).alias("dest_path"),
        F.concat(F.lit("step1_"), page).alias("table_1"),
        F.concat(F.lit("step2_"), page).alias("table_2"),
    )


def declared_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Process, run and event records of many two-step jobs, read back in context."""
    root = fresh_path(spark, "declared")
    create_log(spark, root)
    pipelines.append_jobs(pipelines.two_step_links(_page_jobs(spark, sf_dir)), root)
    log = read_log(spark, root)
    context = inspect.events_in_context(log).select("event", "run", "process", "state")
    return links.declared_links(log.links).join(context, "event")


def delivered_in_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of two-step jobs whose links come in overlapping deliveries, some of them twice."""
    root = fresh_path(spark, "parts")
    jobs = pipelines.two_step_links(_page_jobs(spark, sf_dir))
    parts = [jobs.withColumn("links", F.slice("links", first, 2)) for first in (2, 1, 2)]
    delivered = parts[0].unionByName(parts[1]).unionByName(parts[2])
    for _ in range(2):
        pipelines.append_jobs(delivered, root, token="delivery")
    log = read_log(spark, root)
    context = inspect.events_in_context(log).select("event", "run", "process", "state")
    return links.declared_links(log.links).join(context, "event")


def concurrent_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of all parts, registered by three jobs at once, each part by two of them."""
    root = fresh_path(spark, "shared-entries")
    create_log(spark, root)
    part = F.col("p_partkey").cast("string")
    paths = table(spark, sf_dir, "part").select(
        F.concat(F.lit("part-"), part).alias("entry_id"),
        F.lit("demo").alias("namespace"),
        F.concat(F.lit("gs://bkt/parts/"), part).alias("path"),
        F.col("p_name").alias("display_name"),
        "p_partkey",
    )
    kind = pipelines.EntryKind("part-entry", "part-aspect", "part-aspect-type")

    def register(job: int) -> int:
        wanted = paths.where(F.col("p_partkey") % 3 != job).drop("p_partkey")
        return pipelines.register_paths(wanted, kind, root)

    with ThreadPoolExecutor(3) as pool:
        list(pool.map(register, range(3)))
    return read_log(spark, root).entries.groupBy("entry_id").agg(
        F.count(F.lit(1)).alias("entries"), F.min("fqn").alias("fqn"), F.min("entry_source.display_name").alias("name")
    )


def registered_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Datasets below the root, crawled and registered twice: rows, columns and entries of their tables."""
    namespace, location = fresh_namespace(spark)
    root = f"{location}-log"
    kind = pipelines.EntryKind("dataset-entry", "dataset-aspect", "dataset-aspect-type")
    first, second = [
        pipelines.register_discovered(spark, sf_dir, f"{location}-crawls", namespace, root, kind) for _ in range(2)
    ]
    if second.changed:
        raise RuntimeError(f"read again though nothing changed: {second.changed}")
    entries = read_log(spark, root).entries.groupBy(F.col("entry_source.display_name").alias("dataset"))
    columns = second.columns(spark).groupBy("dataset").agg(F.count(F.lit(1)).alias("columns"))
    rows = None
    for dataset, _ in first.changed:
        name = F.lit(dataset).alias("dataset")
        one = tables.read_table(spark, f"{namespace}.`{dataset}`").select(name).groupBy("dataset")
        one = one.agg(F.count(F.lit(1)).alias("rows"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.join(columns, "dataset").join(entries.agg(F.count(F.lit(1)).alias("entries")), "dataset")


def registered_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table-level links of many copy jobs, with the catalog entries of both ends."""
    root = fresh_path(spark, "copies")
    create_log(spark, root)
    jobs = _page_jobs(spark, sf_dir)
    ends = F.array(
        F.struct(F.lit("-source").alias("end"), F.col("source_path").alias("path")),
        F.struct(F.lit("-dest").alias("end"), F.col("dest_path").alias("path")),
    )
    paths = jobs.select("job_id", "namespace", F.explode(ends).alias("end")).select(
        F.concat("job_id", "end.end").alias("entry_id"), "namespace", "end.path",
        F.col("job_id").alias("display_name"),
    )
    kind = pipelines.EntryKind("page-entry", "page-aspect", "page-aspect-type")
    pipelines.register_paths(paths, kind, root)
    pipelines.append_jobs(pipelines.copy_links(jobs), root)
    log = read_log(spark, root)
    aspect_path = F.col("aspects")["page-aspect"]["data"]["path"]
    # Several pages may share a name: one row per name keeps the joins row for row.
    entries = log.entries.groupBy("fqn").agg(
        F.min("entry_id").alias("entry"),
        F.min("entry_source.resource").alias("resource"),
        F.min(aspect_path).alias("path"),
    )
    sources = entries.select(
        F.col("fqn").alias("source_fqn"),
        F.col("entry").alias("source_entry"),
        F.col("resource").alias("source_resource"),
    )
    targets = entries.select(
        F.col("fqn").alias("target_fqn"),
        F.col("entry").alias("target_entry"),
        F.col("path").alias("target_path"),
    )
    edges = links.declared_links(log.links).select("source_fqn", "target_fqn")
    return edges.join(sources, "source_fqn", "left").join(targets, "target_fqn", "left")


def entry_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Get-or-create an entry for every part; ids that exist keep what they have."""
    root = fresh_path(spark, "entries")
    create_log(spark, root)
    append_records(stored_log(spark, sf_dir).entries, root, "entries")
    part = F.col("p_partkey").cast("string")
    paths = table(spark, sf_dir, "part").select(
        F.concat(F.lit("part-"), part).alias("entry_id"),
        F.lit("demo").alias("namespace"),
        F.concat(F.lit("gs://bkt/parts/"), part, F.lit("/")).alias("path"),
        F.col("p_name").alias("display_name"),
    )
    kind = pipelines.EntryKind("part-entry", "part-aspect", "part-aspect-type")
    pipelines.register_paths(paths, kind, root)
    return read_log(spark, root).entries.select("entry_id", "entry_type", "fqn")


# Lineage queries


def edges_per_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.edges_per_process(stored_log(spark, sf_dir).links)


def edges_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.edges_first_seen(stored_log(spark, sf_dir).links)


def links_by_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.upstream_links(stored_log(spark, sf_dir).links)


def process_by_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspect.process_of_batches(stored_log(spark, sf_dir).processes, batches(spark, sf_dir))


def process_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspect.runs_of_processes(stored_log(spark, sf_dir))


def batch_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspect.events_in_context(stored_log(spark, sf_dir))


def batch_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspect.batch_status(stored_log(spark, sf_dir), batches(spark, sf_dir))


def runs_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspect.runs_by_source(stored_log(spark, sf_dir))


def by_table_gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspect.gated_runs_by_source(stored_log(spark, sf_dir))


def run_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspect.run_details(stored_log(spark, sf_dir))


def process_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.process_identity(stored_log(spark, sf_dir))


def process_identity_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.process_identity(stored_log(spark, sf_dir), identity.cluster_default())


def uniqueness_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.identity_verdicts(stored_log(spark, sf_dir))


def ghost_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.ghost_nodes(stored_log(spark, sf_dir))


def edge_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.edge_visibility(stored_log(spark, sf_dir))


def _names(log: LineageLog) -> DataFrame:
    """(location, kind, name) of all records but entries."""
    records = [
        records.select("location", F.lit(kind).alias("kind"), "name")
        for kind, records in (("process", log.processes), ("run", log.runs), ("event", log.events))
    ]
    left = log.links.select("location", F.lit("link").alias("kind"), F.col("event").alias("name"))
    return records[0].unionByName(records[1]).unionByName(records[2]).unionByName(left)


def _cloned(spark: SparkSession, sf_dir: str, label: str) -> str:
    """A log of its own that begins as the derived one, sharing its files."""
    root = fresh_path(spark, label)
    commits.clone(spark, stored_root(spark, sf_dir), root)
    return root


def purge_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _cloned(spark, sf_dir, "purged")
    audit.purge_log(spark, root, PURGED)
    return _names(read_log(spark, root))


def log_before_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as it was before it was purged, read back after that."""
    root = _cloned(spark, sf_dir, "earlier")
    number = audit.purge_log(spark, root, PURGED).commit
    return _names(read_log(spark, root, number - 1))


def compacted_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log with its small files packed, one location of its links appended once more before."""
    root = _cloned(spark, sf_dir, "compacted")
    again = read_log(spark, root).only(PURGED)
    append(root, {"links": again.links}, token="again")
    append(root, {"links": again.links}, token="again")
    compact(spark, root)
    return _names(read_log(spark, root))


def _recorded_in_parts(spark: SparkSession, sf_dir: str) -> standing.Standing:
    """Distinct links of a log that is appended to, purged and compacted, brought on after each step or two."""
    root = fresh_path(spark, "standing")
    create_log(spark, root)
    log = stored_log(spark, sf_dir)
    append(root, {"entries": log.entries})
    for locations in (PURGED, V.LOCATIONS[1:2], V.LOCATIONS[2:]):
        part = log.only(locations)
        append(root, {"processes": part.processes, "links": part.links})
        standing.refresh(spark, root)
    compact(spark, root)
    audit.purge_log(spark, root, PURGED)
    return standing.refresh(spark, root)


def standing_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.edges_per_process(_recorded_in_parts(spark, sf_dir).links)


def standing_upstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standing.upstream_links(_recorded_in_parts(spark, sf_dir).links)


def standing_ghosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standing.ghost_nodes(_recorded_in_parts(spark, sf_dir).links, stored_log(spark, sf_dir).entries)


def paged_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and ends of events, loaded from a paged export of the log."""
    export, root = fresh_path(spark, "export"), fresh_path(spark, "paged")
    write_export(stored_log(spark, sf_dir), export)
    create_log(spark, root)
    load_paged_log(spark, export, root, fresh_path(spark, "quarantine"))
    log = read_log(spark, root)
    return links.declared_links(log.links).join(log.events.select(F.col("name").alias("event"), "end_time"), "event")


def purge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.purge_counts(stored_log(spark, sf_dir))


def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.graph_nodes(stored_log(spark, sf_dir).links)


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.graph_edges(stored_log(spark, sf_dir).links)


def reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.reach(links.table_edges(stored_log(spark, sf_dir).links))


def reach_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.reach_paths(links.table_edges(stored_log(spark, sf_dir).links, distinct=False))


def lineage_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables that feed each other, over any number of hops."""
    return cycles.cycles(links.table_edges(stored_log(spark, sf_dir).links, distinct=False))


def reach_upstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the reports are made of, over all hops."""
    edges = links.table_edges(stored_log(spark, sf_dir).links, distinct=False)
    reports = edges.select(F.col("target_fqn").alias("node")).where(F.col("node").startswith("bigquery:demo.report."))
    return graph.reach_paths(edges, reports, upstream=True)


QUERIES: dict[str, Query] = {
    "edges_per_batch": edges_per_batch,
    "edges_first_seen": edges_first_seen,
    "links_by_target": links_by_target,
    "process_by_batch": process_by_batch,
    "process_runs": process_runs,
    "batch_events": batch_events,
    "batch_status": batch_status,
    "runs_by_source": runs_by_source,
    "by_table_gated": by_table_gated,
    "run_details": run_details,
    "process_identity": process_identity,
    "process_identity_cluster": process_identity_cluster,
    "uniqueness_verdict": uniqueness_verdict,
    "ghost_nodes": ghost_nodes,
    "edge_visibility": edge_visibility,
    "purge_survivors": purge_survivors,
    "purge_counts": purge_counts,
    "log_before_purge": log_before_purge,
    "compacted_log": compacted_log,
    "standing_edges": standing_edges,
    "standing_upstream": standing_upstream,
    "standing_ghosts": standing_ghosts,
    "paged_log": paged_log,
    "lineage_cycles": lineage_cycles,
    "delivered_in_parts": delivered_in_parts,
    "concurrent_entries": concurrent_entries,
    "registered_datasets": registered_datasets,
    "graph_nodes": graph_nodes,
    "graph_edges": graph_edges,
    "reach": reach,
    "reach_paths": reach_paths,
    "reach_upstream": reach_upstream,
    "emit_links": emit_links,
    "large_events": large_events,
    "files_lineage": files_lineage,
    "table_lineage": table_lineage,
    "failed_lineage": failed_lineage,
    "declared_chain": declared_chain,
    "registered_copies": registered_copies,
    "entry_upsert": entry_upsert,
    "record_names": record_names,
    "fqn_forward": fqn_forward,
    "fqn_to_path": fqn_to_path_of_links,
    "json_field": json_fields,
    "stamp_orders": stamp_orders,
    "overwrite_roundtrip": overwrite_roundtrip,
    "external_table_roundtrip": external_table_roundtrip,
    "table_roundtrip": table_roundtrip,
    "discovered_roundtrip": discovered_roundtrip,
    "suffixed_destinations": suffixed_destinations,
    "two_step_append": two_step_append,
    "two_step_incremental": two_step_incremental,
    "two_step_by_run": two_step_by_run,
    "discover_datasets": discover_datasets,
    "discover_columns": discover_columns,
}
