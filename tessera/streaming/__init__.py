"""Streaming forms of the trace analytics."""
