"""Session settings that the library's plans are made for.

Nothing here is required for right results. Shuffle partitions, memory and
file sizes are the cluster's to choose.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    # Joins and partitions follow the sizes seen at run time.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # A hot key in a join is split over several tasks.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Where each partition of one side is small, hash it instead of sorting both.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB",
    # One wall clock for stamps and for the instants of the log.
    "spark.sql.session.timeZone": "UTC",
}


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder
