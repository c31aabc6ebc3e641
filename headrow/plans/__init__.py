"""Helpers that shape plans: lineage cuts and registered queries."""
