"""Operators for large training-data corpora: tokens, packing, dedup, quality, chat."""
