"""Streams of updates."""
