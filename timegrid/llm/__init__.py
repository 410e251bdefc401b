"""Operators for large text corpora: scoring, search, packing, mixing, archives."""
