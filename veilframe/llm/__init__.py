"""Operators for preparing training data at scale: tokenising, packing, filtering, deduplicating, searching."""
