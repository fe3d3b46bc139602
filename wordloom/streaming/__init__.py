"""Incremental corpus jobs on Structured Streaming."""
