"""Operators: DataFrames in, DataFrame out; nothing is collected."""
