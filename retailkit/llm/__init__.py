"""Training-data operators: URL filter, secret scan, packing, fingerprints, sharding,
chat formatting, quality rules, license scan, BPE tokenization and near-duplicate detection.

Nothing outside this package imports it; ``retailkit.llm.registry`` lists its queries.
"""
