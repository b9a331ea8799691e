"""Landmark-sequence analytics on Spark."""
