"""Parquet directories and catalog tables.

Every function works on names or paths, so the storage behind them (session
catalog, V2 catalog, external connector) is a matter of configuration.
"""

from __future__ import annotations

import json
import re
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SESSION_CATALOG = "spark_catalog"


def read_dir(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def overwrite_dir(df: DataFrame, path: str) -> None:
    """Replace the whole directory, whatever files it held.

    Spark empties the directory before it reads, so a frame that reads from
    there is refused while its files still exist.
    """
    if reads_from(df, path):
        raise ValueError(f"cannot overwrite {path}: the data to write is read from there")
    df.write.mode("overwrite").parquet(path)


def reads_from(df: DataFrame, path: str) -> bool:
    """Whether some input file of `df` lies at or below `path`.

    A path without a scheme is compared without scheme and authority.
    """
    def shortened(uri: str) -> str:
        drop = r"^[a-z0-9+.-]+:" if "://" in path else r"^[a-z0-9+.-]+:(//[^/]*)?"
        return re.sub(drop, "", unquote(uri))

    root = shortened(path).rstrip("/")
    files = map(shortened, df.inputFiles())
    return any(file == root or file.startswith(f"{root}/") for file in files)


def read_table(spark: SparkSession, name: str, connector: str | None = None, **options: str) -> DataFrame:
    """A catalog table, or the same name through an external connector."""
    if connector is None:
        return spark.table(name)
    return spark.read.format(connector).options(**options).option("table", name).load()


def overwrite_table(df: DataFrame, name: str, connector: str | None = None, **options: str) -> None:
    """Replace a table; a connector takes its staging place from `options`."""
    if connector is None:
        df.write.mode("overwrite").saveAsTable(name)
    else:
        df.write.format(connector).options(**options).option("table", name).mode("overwrite").save()


def load_table(spark: SparkSession, uri: str, name: str) -> None:
    """Load job: files to a table, created if needed, truncated if there."""
    overwrite_table(read_dir(spark, uri), name)


def register_external(spark: SparkSession, name: str, location: str) -> None:
    """Give the Parquet files below `location` a table name."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} USING parquet LOCATION {_quoted(location)}")


def replace_external(spark: SparkSession, name: str, location: str) -> None:
    """As `register_external`, with the columns that the files have now; no file is touched."""
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    register_external(spark, name, location)


def _quoted(text: str) -> str:
    """As a literal of SQL."""
    escaped = text.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def table_location(spark: SparkSession, name: str) -> str:
    """Where the files of a table lie; its columns may be called anything."""
    described = spark.sql(f"DESCRIBE TABLE EXTENDED {name} AS JSON").first()[0]
    return json.loads(described)["location"]


def overwrite_external(df: DataFrame, name: str) -> None:
    """Write to an external table by replacing the files below it."""
    spark = df.sparkSession
    overwrite_dir(df, table_location(spark, name))
    spark.sql(f"REFRESH TABLE {name}")


def ensure_namespace(
    spark: SparkSession, name: str, location: str, properties: dict[str, str] | None = None
) -> None:
    statement = f"CREATE NAMESPACE IF NOT EXISTS {name} LOCATION {_quoted(location)}"
    if properties:
        pairs = ", ".join(f"{_quoted(key)} = {_quoted(value)}" for key, value in properties.items())
        statement += f" WITH DBPROPERTIES ({pairs})"
    spark.sql(statement)


def ensure_table(df: DataFrame, name: str, provider: str = "parquet", partitioned_by: str | None = None) -> None:
    """Create the table from the schema of `df`; an existing table stays as it is."""
    ddl = df.schema.toDDL()
    parts = f" PARTITIONED BY (`{partitioned_by}`)" if partitioned_by else ""
    df.sparkSession.sql(f"CREATE TABLE IF NOT EXISTS {name} ({ddl}) USING {provider}{parts}")


def replace_partition(df: DataFrame, name: str, column: str, value: str) -> None:
    """Replace one partition of a table by the rows of `df`, other columns by name; other partitions stay."""
    spark = df.sparkSession
    if not _is_session_table(spark, name):
        df.withColumn(column, F.lit(value)).writeTo(name).overwrite(F.col(column) == value)
        return
    # Inserted by position here.
    columns = ", ".join(f"`{other}`" for other in spark.table(name).columns if other != column)
    spark.sql(
        f"INSERT OVERWRITE TABLE {name} PARTITION (`{column}` = {_quoted(value)}) SELECT {columns} FROM {{df}}", df=df
    )


def append_table(df: DataFrame, name: str) -> None:
    """Append by column name.

    Tables of a V2 catalog take `writeTo`, those of the session catalog do
    not; both forms match columns by name.
    """
    if _is_session_table(df.sparkSession, name):
        df.write.mode("append").saveAsTable(name)
    else:
        df.writeTo(name).append()


def _is_session_table(spark: SparkSession, name: str) -> bool:
    parts = [part.strip("`") for part in name.split(".")]
    catalog = parts[0] if len(parts) == 3 else spark.catalog.currentCatalog()
    return catalog == SESSION_CATALOG


def suffixed(name: str, suffix: str) -> str:
    """Destination name of a run that keeps its output apart."""
    return f"{name}{suffix}"
