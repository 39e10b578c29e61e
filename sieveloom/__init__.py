"""Curation analytics on Spark."""
