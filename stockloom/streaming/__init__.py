"""Structured Streaming ingest and state."""
