"""Operators for building training corpora: filtering, scoring, near-duplicate
joins, vector search, archives, packing and tokenisation.

Nothing outside this package imports it.
"""
