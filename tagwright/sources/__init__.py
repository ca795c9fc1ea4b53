"""Readers and writers: parquet tables, CSV, JSONL, text."""
