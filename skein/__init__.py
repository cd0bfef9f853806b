"""Skein: SQL-lineage and metadata-graph analytics expressed as Spark jobs."""
