"""Operators for preparing text corpora: filtering, deduplication, extraction, mixing and packing.

Nothing else in the library imports this subpackage.
"""
