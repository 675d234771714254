"""Whole runs, and the queries that the driver knows."""
