"""Append logs, resume and last-entry state on Structured Streaming."""
