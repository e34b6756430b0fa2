"""Operators for large training-data pipelines; nothing else in oxbow imports them."""
