"""Readers and writers for logs, datasets, captures and snapshots."""
