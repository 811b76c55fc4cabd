"""Readers: review tables, line-oriented review text, comma-separated records."""
