"""Fully qualified names (FQNs) and hierarchical record names, Column to Column.

All of it is built-in expressions, so it stays inside whole-stage codegen.
An FQN does not keep its path: ``a.b`` may come from ``a/b`` or from ``a.b``.
Keep the path in a column of its own where it matters.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewell import fixed_values as V


def strip_slash(path: Column) -> Column:
    """Drop one trailing slash, and only one."""
    return F.when(path.endswith("/"), F.left(path, F.length(path) - 1)).otherwise(path)


def _dotted(path: Column) -> Column:
    bare = F.replace(strip_slash(path), F.lit(V.STORAGE_URI), F.lit(""))
    return F.replace(bare, F.lit("/"), F.lit("."))


def gcs_fqn(path: Column) -> Column:
    return F.concat(F.lit(V.GCS), _dotted(path))


def custom_fqn(namespace: Column, path: Column) -> Column:
    return F.concat(F.lit(V.CUSTOM), namespace, F.lit("."), _dotted(path))


def table_fqn(project: Column, namespace: Column, table: Column) -> Column:
    dot = F.lit(".")
    return F.concat(F.lit(V.BIGQUERY), project, dot, namespace, dot, table)


def column_fqn(fqn: Column, column: Column) -> Column:
    return F.concat(fqn, F.lit("."), column)


def parent_fqn(fqn: Column) -> Column:
    """The table of a column FQN: everything before the last dot."""
    last = F.substring_index(fqn, ".", -1)
    before = F.left(fqn, F.length(fqn) - F.length(last) - 1)
    return F.when(fqn.contains("."), before).otherwise(fqn)


def system_resource(path: Column) -> Column:
    return F.replace(strip_slash(path), F.lit(V.STORAGE_URI), F.lit(V.STORAGE_RESOURCE))


def fqn_to_path(fqn: Column) -> Column:
    """``gcs:`` FQN to a storage path; only the first dot becomes a slash."""
    rest = F.substring(fqn, len(V.GCS) + 1, 2147483647)
    bucket = F.substring_index(rest, ".", 1)
    inside = F.substring(rest, F.length(bucket) + 2, F.length(rest))
    nested = F.concat(F.lit(V.STORAGE_URI), bucket, F.lit("/"), inside)
    path = F.when(rest.contains("."), nested).otherwise(F.concat(F.lit(V.STORAGE_URI), rest))
    return F.when(fqn.startswith(V.GCS), path).otherwise(fqn)


def normalise_identifier(identifier: Column) -> Column:
    """Read an identifier without a known scheme as a table name."""
    known = (
        identifier.startswith(V.BIGQUERY)
        | identifier.startswith(V.CUSTOM)
        | identifier.startswith(V.GCS)
    )
    return F.when(known, identifier).otherwise(F.concat(F.lit(V.BIGQUERY), identifier))


def run_of(record: Column) -> Column:
    """Run name: the first eight parts of an event name."""
    return F.substring_index(record, "/", 8)


def process_of(record: Column) -> Column:
    """Process name: the first six parts of a run or event name."""
    return F.substring_index(record, "/", 6)


def link_level(source: Column, target: Column) -> Column:
    """Level of a link that does not declare one.

    Only table names have a fixed number of parts, so only there can a column
    suffix be told from a path.
    """
    def is_column(fqn: Column) -> Column:
        parts = F.size(F.split(fqn, r"\."))
        return F.coalesce(fqn.startswith(V.BIGQUERY) & (parts == 4), F.lit(False))

    return F.when(is_column(source) & is_column(target), V.COLUMN_LEVEL).otherwise(V.TABLE_LEVEL)
