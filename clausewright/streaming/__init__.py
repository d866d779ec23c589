"""Incremental ingestion through Structured Streaming."""
