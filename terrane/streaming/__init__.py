"""Incremental versions of the evaluation aggregates."""
