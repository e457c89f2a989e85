"""Predicates, joins, projections and windows that queries are made of."""
