"""Operators for preparing training text: deduplication, language, extraction, tokens, mixing and sharding."""
