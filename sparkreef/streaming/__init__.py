"""Structured Streaming: digests that keep state between runs, alerts, windows."""
