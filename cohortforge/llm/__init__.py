"""Training-data operators: sharding, quality, WARC, LM scoring, search, mixing, packing, near-dedup, language ID.

Nothing else in the library imports this subpackage; it only borrows general helpers (session, paths).
"""
