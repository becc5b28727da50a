"""Operators for training-data pipelines: search, dedup, packing, scoring, tokens and chat text."""
