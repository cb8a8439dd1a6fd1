"""Catalog, access checks and the registered queries."""
