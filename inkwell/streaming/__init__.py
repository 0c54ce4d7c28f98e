"""Incremental forms of the state operators over Structured Streaming."""
