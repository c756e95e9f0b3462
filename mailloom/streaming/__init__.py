"""Incremental ingestion as a stream of files."""
