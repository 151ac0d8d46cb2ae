"""What makes two runs the same process: namespace and application name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell import fixed_values as V
from tracewell.functions import process_of
from tracewell.sources.log import LineageLog


def namespace_of(default: Column) -> Column:
    return F.coalesce(F.col("attributes").getItem(V.NAMESPACE_PROPERTY), default)


def app_name_of() -> Column:
    """A process without any name is known by its own, so that unrelated ones stay apart."""
    attributes = F.col("attributes")
    return F.coalesce(
        attributes.getItem(V.APP_NAME_PROPERTY), attributes.getItem(V.SPARK_APP_NAME), F.col("name")
    )


def project_of(process: Column) -> Column:
    return F.substring_index(F.substring_index(process, "/", 2), "/", -1)


def serverless_default() -> Column:
    """Namespace of a serverless batch that sets none."""
    return F.lit(V.DEFAULT_NAMESPACE)


def cluster_default() -> Column:
    """Namespace of a cluster job that sets none: its project."""
    return project_of(F.col("name"))


def session_properties(spark: SparkSession) -> dict[str, str]:
    """The settings of a session that say which process its runs belong to."""
    keys = (V.NAMESPACE_PROPERTY, V.APP_NAME_PROPERTY, V.SPARK_APP_NAME)
    given = {key: spark.conf.get(key, None) for key in keys}
    return {key: value for key, value in given.items() if value is not None}


def identity_members(processes: DataFrame, default_namespace: Column | None = None) -> DataFrame:
    """Each process with its identity; the batch it ran as plays no part."""
    default = serverless_default() if default_namespace is None else default_namespace
    spark_app = F.coalesce(F.col("attributes").getItem(V.SPARK_APP_NAME), app_name_of())
    members = processes.select(
        F.col("name").alias("process"),
        F.struct(
            namespace_of(default).alias("namespace"),
            app_name_of().alias("app_name"),
            spark_app.alias("spark_app_name"),
        ).alias("identity"),
    )
    # A process that was delivered twice is still one.
    return members.groupBy("process").agg(F.min("identity").alias("identity")).select("process", "identity.*")


def _runs_per_process(runs: DataFrame) -> DataFrame:
    return (
        runs.groupBy(process_of(F.col("name")).alias("process"))
        .agg(F.count(F.lit(1)).alias("runs"), F.min(F.struct("start_time", "name")).alias("first"))
    )


def process_identity(log: LineageLog, default_namespace: Column | None = None) -> DataFrame:
    """Identities with the number of processes and runs that share them; a process without runs has 0.

    Runs are counted per process before the join, so the join has one row per
    process on both sides.
    """
    members = identity_members(log.processes, default_namespace)
    return (
        members.join(_runs_per_process(log.runs), "process", "left")
        .groupBy("namespace", "app_name")
        .agg(F.count(F.lit(1)).alias("processes"), F.coalesce(F.sum("runs"), F.lit(0)).alias("runs"))
    )


def identity_verdicts(log: LineageLog, default_namespace: Column | None = None) -> DataFrame:
    """Whether runs of one application consolidate with its first run or split off.

    The application is what `spark.app.name` says. Rows are identities, not
    runs: `runs` of them either share the identity of the first run
    (`consolidated`) or have another namespace or application name. Identities
    without runs come after all with runs, by name.
    """
    members = identity_members(log.processes, default_namespace)
    identities = (
        members.join(_runs_per_process(log.runs), "process", "left")
        .groupBy("spark_app_name", "namespace", "app_name")
        .agg(F.coalesce(F.sum("runs"), F.lit(0)).alias("runs"), F.min("first").alias("first"))
    )
    baseline = identities.groupBy(F.col("spark_app_name").alias("base_app")).agg(
        F.min(F.struct(F.col("first").isNull().alias("none"), "first", "namespace", "app_name")).alias("base")
    )
    verdict = (
        F.when(~F.col("namespace").eqNullSafe(F.col("base.namespace")), "new_namespace")
        .when(~F.col("app_name").eqNullSafe(F.col("base.app_name")), "new_app_name")
        .otherwise("consolidated")
    )
    same_app = F.col("spark_app_name").eqNullSafe(F.col("base_app"))
    return identities.join(baseline, same_app).select(
        "spark_app_name", "namespace", "app_name", "runs", verdict.alias("verdict")
    )
