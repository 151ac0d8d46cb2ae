"""Stamping, lineage recording and the queries over the lineage log."""
