"""Readers, writers and the derivation of scenes from tables."""
