"""Structured Streaming versions of ingest, rollups, trends and alerts."""
