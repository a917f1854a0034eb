"""Readers of building tables."""
