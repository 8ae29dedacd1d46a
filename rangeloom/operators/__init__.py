"""Operators over interval tables, tracks, rectangles and sequences."""
