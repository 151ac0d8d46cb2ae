"""A lineage log derived from the benchmark tables.

A customer is a process, an order a run, a line an event. The links of an
event follow a chain of datasets: part to supplier, supplier to the customer's
mart, mart to the report of the nation, the last also as a column link. Parts
and suppliers share one name space, so there are self-links and cycles.
Details of customers far in debt, runs of customers far in credit, entries of
large parts and the source of some links are missing on purpose.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell import fixed_values as V
from tracewell.functions import column_fqn, table_fqn
from tracewell.operators.record import link
from tracewell.sources.log import LineageLog, append_log, read_log
from tracewell.sources.workspace import fresh_path

PROJECT = "demo"
#: Lines in a task that names events and links: these are much wider than what is shuffled, and are sorted in memory.
TASK_LINES = 600_000

_stored: dict[tuple[str, str], str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(column: Column) -> Column:
    return column.cast("string")


def dataset_fqn(key: Column) -> Column:
    """Name of the dataset with a key, in one of the three schemes."""
    digit = _text(key % 10)
    return (
        F.when(key % 3 == 0, F.concat(F.lit("gcs:bkt"), digit, F.lit(".d"), _text(key)))
        .when(key % 3 == 1, F.concat(F.lit("bigquery:demo.ds"), digit, F.lit(".t"), _text(key)))
        .otherwise(F.concat(F.lit("custom:demo.bkt"), digit, F.lit(".d"), _text(key)))
    )


def _table_name(namespace: str, key: Column) -> Column:
    return table_fqn(F.lit(PROJECT), F.lit(namespace), F.concat(F.lit("t"), _text(key)))


def customer_location() -> Column:
    place = F.col("c_nationkey") % 3
    first, second, third = V.LOCATIONS
    return F.when(place == 0, first).when(place == 1, second).otherwise(third)


def process_name() -> Column:
    return F.concat(
        F.lit(f"projects/{PROJECT}/locations/"),
        customer_location(),
        F.lit("/processes/p"),
        _text(F.col("c_custkey")),
    )


def run_name() -> Column:
    return F.concat(process_name(), F.lit("/runs/r"), _text(F.col("o_orderkey")))


def processes(spark: SparkSession, sf_dir: str) -> DataFrame:
    segment = F.col("c_mktsegment")
    nation = _text(F.col("c_nationkey"))
    properties = {
        V.JOB_ID: F.when(segment == "BUILDING", F.concat(F.lit("job_"), nation)),
        V.NAMESPACE_PROPERTY: F.when(
            segment.isin("AUTOMOBILE", "BUILDING"), F.concat(F.lit("ns_"), nation)
        ),
        V.APP_NAME_PROPERTY: F.when(F.col("c_nationkey") < 12, segment),
        V.SPARK_APP_NAME: F.concat(F.lit("app_"), nation),
    }
    given = F.map_filter(
        F.create_map(*[part for key, value in properties.items() for part in (F.lit(key), value)]),
        lambda _, value: value.isNotNull(),
    )
    return (
        table(spark, sf_dir, "customer")
        .where(F.col("c_acctbal") >= -900)
        .select(
            process_name().alias("name"),
            F.when(F.col("c_acctbal") >= 0, F.col("c_name")).alias("display_name"),
            given.alias("attributes"),
            F.struct(
                F.lit(V.CUSTOM_ORIGIN).alias("source_type"),
                F.concat(F.lit("batch-"), _text(F.col("c_custkey"))).alias("name"),
            ).alias("origin"),
            customer_location().alias("location"),
        )
    )


def _orders_with_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus")
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.col("o_orderstatus")
    return _orders_with_customer(spark, sf_dir).where(F.col("c_acctbal") <= 9000).select(
        run_name().alias("name"),
        F.lit(None).cast("string").alias("display_name"),
        F.col("o_orderdate").alias("start_time"),
        F.col("o_orderdate").alias("end_time"),
        F.when(status == "F", V.COMPLETED).otherwise(status).alias("state"),
        customer_location().alias("location"),
    )


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What events and links take of each line, with the customer of its order."""
    # What the links ask of a line is told before the shuffle: flags are narrower than what they come from.
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate",
        ((F.col("l_discount") == 0) & (F.col("l_tax") == 0)).alias("untracked"),
        (F.col("l_returnflag") == "R").alias("returned"),
        (F.col("l_linestatus") == "F").alias("filled"),
    )
    orders = _orders_with_customer(spark, sf_dir).select("o_orderkey", "c_custkey", "c_nationkey")
    # Tasks get a bounded number of lines: by the size of what is shuffled they would get too many to sort in memory.
    tasks = -(-lines.count() // TASK_LINES)
    if tasks > spark.sparkContext.defaultParallelism:
        lines, orders = lines.repartition(tasks, "l_orderkey"), orders.repartition(tasks, "o_orderkey")
    # Lines and orders both grow with the data, so neither side is broadcast.
    return lines.join(orders.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))


def _declared(lines: DataFrame) -> DataFrame:
    """Events with their one to four links, made from one row each."""
    rows = lines.withColumns(
        {
            "supplier": dataset_fqn(F.col("l_suppkey")),
            "mart": _table_name("mart", F.col("c_custkey")),
            "report": _table_name("report", F.col("c_nationkey")),
            "location": customer_location(),
        }
    )
    part = F.when(~F.col("untracked"), dataset_fqn(F.col("l_partkey")))
    supplier, mart, report = F.col("supplier"), F.col("mart"), F.col("report")
    columns = link(
        column_fqn(mart, F.lit("pipeline_id")), column_fqn(report, F.lit("processing_step")), V.COLUMN_LEVEL
    )
    none = F.array().cast("array<struct<source:string,target:string,level:string>>")
    chain = F.concat(
        F.array(link(part, supplier)),
        F.when(F.col("filled"), F.array(link(supplier, mart))).otherwise(none),
        F.when(F.col("returned"), F.array(link(mart, report), columns)).otherwise(none),
    )
    shipped = F.col("l_shipdate").cast("date")
    parts = [F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"), shipped]
    event = F.concat_ws("-", *map(_text, parts))
    return rows.select(
        F.concat(run_name(), F.lit("/lineageEvents/e"), event).alias("name"),
        F.col("l_shipdate").alias("start_time"),
        F.when(F.col("returned"), F.col("l_shipdate") + F.expr("INTERVAL 1 DAY")).alias("end_time"),
        chain.alias("links"),
        "location",
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(_lines(spark, sf_dir))


def _events(lines: DataFrame) -> DataFrame:
    return _declared(lines).drop("links")


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _links(_lines(spark, sf_dir))


def _links(lines: DataFrame) -> DataFrame:
    rows = _declared(lines).select(
        F.col("name").alias("event"), "start_time", F.posexplode("links").alias("link_pos", "link"), "location"
    )
    return rows.select("event", "start_time", "link_pos", "link.source", "link.target", "link.level", "location")


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").where(F.col("p_size") <= 45)
    marts = table(spark, sf_dir, "customer").where(F.col("c_acctbal") >= 0)
    described = [
        parts.select(
            F.concat(F.lit("part-"), _text(F.col("p_partkey"))).alias("entry_id"),
            dataset_fqn(F.col("p_partkey")).alias("fqn"),
            F.col("p_name").alias("display_name"),
        ),
        marts.select(
            F.concat(F.lit("mart-"), _text(F.col("c_custkey"))).alias("entry_id"),
            _table_name("mart", F.col("c_custkey")).alias("fqn"),
            F.col("c_name").alias("display_name"),
        ),
    ]
    aspect = "struct<aspect_type:string,data:struct<format:string,framework:string,path:string>>"
    return described[0].unionByName(described[1]).select(
        "entry_id",
        F.lit("dataset").alias("entry_type"),
        "fqn",
        F.struct(
            F.lit(None).cast("string").alias("resource"),
            F.lit(V.STORAGE_SYSTEM).alias("system"),
            "display_name",
        ).alias("entry_source"),
        F.lit(None).cast(f"map<string,{aspect}>").alias("aspects"),
    )


def derive_log(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None) -> LineageLog:
    """`lines`: those of `_lines`, where the caller keeps them for both kinds that are made of them."""
    lines = _lines(spark, sf_dir) if lines is None else lines
    return LineageLog(
        processes(spark, sf_dir),
        runs(spark, sf_dir),
        _events(lines),
        _links(lines),
        entries(spark, sf_dir),
    )


def stored_root(spark: SparkSession, sf_dir: str) -> str:
    """Where the derived log is, recorded once per application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _stored:
        root = fresh_path(spark, "log")
        # Events and links are written side by side: kept, the lines are shuffled once for both.
        lines = _lines(spark, sf_dir).persist()
        try:
            append_log(derive_log(spark, sf_dir, lines), root)
        finally:
            lines.unpersist()
        _stored[key] = root
    return _stored[key]


def stored_log(spark: SparkSession, sf_dir: str) -> LineageLog:
    return read_log(spark, stored_root(spark, sf_dir))


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch ids to look up: every customer's, and every job id in use."""
    own = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("batch-"), _text(F.col("c_custkey"))).alias("batch_id")
    )
    jobs = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("job_"), _text(F.col("c_nationkey"))).alias("batch_id")
    )
    return own.unionByName(jobs.distinct())
