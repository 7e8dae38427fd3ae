"""Structured Streaming: resumable ingest, running deduplication, per-request state, metrics."""
