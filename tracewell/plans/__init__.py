"""Whole pipelines, composed of sources, stamps, sinks and lineage records."""
