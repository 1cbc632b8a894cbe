"""Operators for large text corpora: filtering, extraction, tokens, scoring and deduplication.

Nothing else in the library imports this subpackage.
"""
