"""Structured Streaming versions of the incremental metric-log jobs."""
