"""Reusable plans: proximity joins, ordered acceptance, shortest paths."""
