"""Scans, sessions and sinks."""
