"""Provenance-stamping pipelines and lineage-log queries for PySpark."""
