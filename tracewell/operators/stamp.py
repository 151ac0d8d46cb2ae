"""Provenance columns."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stamp(
    df: DataFrame,
    time_column: str,
    constants: Mapping[str, str],
    as_of: datetime | Column | None = None,
) -> DataFrame:
    """Add a processing time and constant columns to every row.

    Without `as_of` the time is that of the query: one value per action, and
    another one for the next action. A column of the same name is replaced.
    """
    if as_of is None:
        clock = F.current_timestamp()
    else:
        clock = as_of if isinstance(as_of, Column) else F.lit(as_of)
    columns = {name: F.lit(value) for name, value in constants.items()}
    return df.withColumns({time_column: clock, **columns})


def stamp_pipeline(df: DataFrame, pipeline_id: str, as_of: datetime | Column | None = None) -> DataFrame:
    return stamp(df, "processed_timestamp", {"pipeline_id": pipeline_id}, as_of)


def stamp_ingestion(df: DataFrame, pipeline_id: str, as_of: datetime | Column | None = None) -> DataFrame:
    return stamp(df, "ingestion_timestamp", {"pipeline_id": pipeline_id}, as_of)


def stamp_step(df: DataFrame, step: str, as_of: datetime | Column | None = None) -> DataFrame:
    return stamp(df, "processing_timestamp", {"processing_step": step}, as_of)
