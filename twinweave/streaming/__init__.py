"""Structured Streaming ingest: new image files become feature rows, batch by batch."""
