"""Operators for large text corpora: formatting, filtering, deduplication, tokens, packing, sharding, archives."""
