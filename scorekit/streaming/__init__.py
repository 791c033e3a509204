"""Incremental ingest of crawl batches with Structured Streaming."""

from .batch_ingest import start_ingest  # noqa: F401
