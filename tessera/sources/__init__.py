"""Readers and writers of traces, particles, meshes, operation logs and machine descriptions."""
