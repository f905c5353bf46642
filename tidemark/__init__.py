"""Keyed time-series and reference-data operators and batch jobs on Spark DataFrames."""
