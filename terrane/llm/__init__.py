"""Operators for preparing training data: thirteen operators, their queries and their oracle SQL."""
