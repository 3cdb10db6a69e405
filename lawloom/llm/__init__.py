"""Operators for preparing text, entities and vectors for training; nothing else in the library imports them."""
