"""Training-data operators: dedup, quality, PII, mixing, tokenizing, archives, extraction.

Nothing outside this subpackage imports it.
"""
