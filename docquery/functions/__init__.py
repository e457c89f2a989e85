"""Functions on columns: LIKE patterns, JSON members, compressed JSON, parameters of raw SQL."""
