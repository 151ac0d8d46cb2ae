"""Column expressions over fully qualified names and record payloads."""

from tracewell.functions.names import (
    column_fqn,
    custom_fqn,
    fqn_to_path,
    gcs_fqn,
    link_level,
    normalise_identifier,
    parent_fqn,
    process_of,
    run_of,
    strip_slash,
    system_resource,
    table_fqn,
)
from tracewell.functions.payload import instant, json_field, required_json_field

__all__ = [
    "column_fqn",
    "custom_fqn",
    "fqn_to_path",
    "gcs_fqn",
    "instant",
    "json_field",
    "link_level",
    "normalise_identifier",
    "parent_fqn",
    "process_of",
    "required_json_field",
    "run_of",
    "strip_slash",
    "system_resource",
    "table_fqn",
]
