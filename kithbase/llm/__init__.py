"""Training-data operators: dedup, tokenising, formatting, quality, sharding, PII, mixing, fingerprints, LM scoring.

Nothing outside this subpackage imports it.
"""
