"""Durable cuts of long plans, the query registry, and the queries with their SQL counterparts."""
