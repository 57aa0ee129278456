"""Filtered vector analytics on Spark."""
