"""Operators for large training corpora: scoring, dedup, decontamination, packing, sharding, search."""
