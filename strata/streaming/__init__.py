"""Structured Streaming ingestion into a store."""
