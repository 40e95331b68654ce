"""Structured Streaming forms of the landing step."""
