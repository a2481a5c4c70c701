"""Training-data operators: deduplication, filtering, extraction, tokenisation.

Nothing outside this subpackage imports it.
"""
