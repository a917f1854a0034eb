"""Ingest of models as their files arrive."""
