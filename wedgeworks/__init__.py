"""Exact triangle counting and graph processing on Spark DataFrames."""
