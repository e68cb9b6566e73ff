"""Incremental jobs as Structured Streaming queries."""
