"""Incremental view analytics on Spark DataFrames."""
