"""Operators of a training-data pipeline: each in its own module, their queries in queries.py."""
