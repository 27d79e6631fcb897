"""Structured Streaming jobs: scoring and the running control limit."""
