"""Operators: each takes and gives lazy DataFrames; only fits bring a few numbers to the driver."""
