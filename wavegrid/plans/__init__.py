"""Schemas, whole analyses and the registered queries."""
