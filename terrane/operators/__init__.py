"""Operators on DataFrames: spatial joins, evaluation, graphs, grids, generators."""
