"""Operators for preparing training data: search, sharding, deduplication, language models, mixing and token files."""
