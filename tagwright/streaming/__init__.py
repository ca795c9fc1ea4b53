"""Structured Streaming forms of the workflow (answers arriving as files)."""
