"""Operators of a training-data pipeline; ``queries`` binds each to the given tables."""
