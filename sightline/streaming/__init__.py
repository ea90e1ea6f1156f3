"""Incremental reconstruction on Structured Streaming."""
