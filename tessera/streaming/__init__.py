"""Incremental ingest (an extension: all other operators work on whole tables)."""
