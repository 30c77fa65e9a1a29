"""Operators of a training-data pipeline over document tables.

Nothing else in the library imports this package. Every operator selects the
columns it needs by position of its parameters, so extra columns are ignored.
"""
