"""Operators for training-data corpora: deduplication, filters, mixing, tokens.

Nothing outside this package imports it. Every operator works on a DataFrame of
documents and returns a DataFrame; ``queries`` registers one query for each.
"""
