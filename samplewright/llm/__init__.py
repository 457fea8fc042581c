"""Operators for training-data pipelines: sharding, packing, deduplication,
language ID, licence lookup, token counts and mixing.

Nothing outside this subpackage imports it.
"""
