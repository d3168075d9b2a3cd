"""Structured Streaming forms of the pipelines."""
