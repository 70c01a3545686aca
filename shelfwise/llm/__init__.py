"""Operators for large training-data corpora: filtering, deduplication,
tagging, sharding, packing and token counts over a ``documents`` table.

Nothing else in the library imports this subpackage; it may be left out.
"""
