"""Structured Streaming views of the event log, heartbeats and completions."""
