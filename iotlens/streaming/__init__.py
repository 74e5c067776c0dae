"""Structured Streaming forms of the per-source state and the counters."""
