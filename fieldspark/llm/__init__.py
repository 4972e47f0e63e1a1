"""Operators for preparing training text: filtering, deduplication, sharding, search, tokenizing."""
