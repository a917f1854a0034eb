"""Operators of a large-scale training-data pipeline.

Nothing else in the library imports this subpackage; the registered queries live in ``wayhall.llm.queries``.
"""
