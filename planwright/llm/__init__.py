"""Training-data operators: fingerprints, deduplication, tokenizing, scoring, packing.

Nothing outside this subpackage imports it; it can be removed as a whole.
"""
