"""Immutable queries that lower to DataFrames, and named SQL objects made of them."""
