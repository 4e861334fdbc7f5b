"""Operators for text corpora used in model training; nothing outside this package imports them."""
