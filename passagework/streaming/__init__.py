"""Feeding the index from streams."""
