"""Structured Streaming forms of the record keeping."""
