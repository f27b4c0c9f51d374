"""Workloads from tables to report, and the queries by operator."""
