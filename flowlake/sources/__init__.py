"""Scans, ingest jobs and sinks."""
