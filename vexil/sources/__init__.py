"""Readers and writers of vector files and results."""
