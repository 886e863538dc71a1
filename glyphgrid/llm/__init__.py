"""Operators of a training-data pipeline: dedup, sharding, tokenising, language ID, search, mixing, toxicity. Nothing else in the library imports this."""
