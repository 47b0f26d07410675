"""Operators for large text corpora: deduplication, quality, packing, mixing, sharding, search.

Nothing else in the library imports this subpackage.
"""
