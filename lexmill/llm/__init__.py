"""Operators for preparing training data: tokenising, deduplicating, sharding, mixing, searching, filtering."""
