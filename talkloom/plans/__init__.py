"""Composite queries and the registry of named queries."""
