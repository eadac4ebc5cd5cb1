"""Structured Streaming: idempotent ingestion."""
