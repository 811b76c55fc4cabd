"""Index, lookup, ranking, ordering and skew operators."""
