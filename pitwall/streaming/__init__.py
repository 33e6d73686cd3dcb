"""Structured Streaming jobs: incremental landing and incremental staging."""
