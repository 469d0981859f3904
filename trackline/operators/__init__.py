"""Reusable DataFrame operators: ordered series, runs, joins, quantiles, statistics."""
