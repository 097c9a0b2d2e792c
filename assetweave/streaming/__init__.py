"""Structured Streaming jobs over the call log and snapshots."""
