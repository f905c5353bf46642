"""Operators of a training-data pipeline, their queries and SQL. Nothing else in the library imports this."""
