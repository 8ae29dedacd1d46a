"""Readers and writers of the text formats of intervals, tracks and sequences."""
