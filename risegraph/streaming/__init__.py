"""Structured Streaming entry points."""

from .ingest import incremental_ingest, submission_stream

__all__ = ["incremental_ingest", "submission_stream"]
