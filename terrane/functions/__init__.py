"""Scalar functions as Column expressions: geometry, statistics, text, networks."""
