"""Structured Streaming: ingestion with per-series order, continuous rollups, batched counts."""
