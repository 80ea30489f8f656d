"""Continuous reading of logs on Structured Streaming."""
