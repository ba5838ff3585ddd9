"""Operators for training-data corpora: dedup, language, archives, extraction, privacy, packing, tokens."""
