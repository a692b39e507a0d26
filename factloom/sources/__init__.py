"""Scans and sinks: the driver tables as facts, JSON lines, snapshots and repository files."""
