"""Operators a training-data pipeline needs, each with its query over the given tables.

Nothing else in the library imports this package; it may import the library's general helpers.
"""
