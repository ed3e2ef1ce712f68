"""Ingest as a Structured Streaming job."""
