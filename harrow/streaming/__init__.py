"""Incremental index blocks from arriving reviews."""
