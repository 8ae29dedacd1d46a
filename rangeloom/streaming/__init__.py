"""Tracks from streams."""
