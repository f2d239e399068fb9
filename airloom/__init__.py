"""Temporal navigation-data analytics on Spark."""
