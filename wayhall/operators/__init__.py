"""Stages that turn building tables into graph relations."""
