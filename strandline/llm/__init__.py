"""Operators for large text and sequence collections; nothing else in the library imports this package."""
