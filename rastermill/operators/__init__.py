"""Joins and aggregates on cells, zones and truth."""
