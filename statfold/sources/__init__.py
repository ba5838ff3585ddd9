"""Readers and writers: driver tables, CSV with NA tokens, documents, datasets."""
