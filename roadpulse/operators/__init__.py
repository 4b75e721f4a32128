"""Operators: each a function of DataFrames returning a lazily planned DataFrame."""
