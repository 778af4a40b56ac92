"""Incremental runs."""

from galley.streaming.ingest import ingest

__all__ = ["ingest"]
