"""Retrieval and corpus processing for product reviews, expressed as Spark plans."""
