"""Incremental ingest of landed commit files."""
