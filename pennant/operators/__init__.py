"""Operators over games, coefficients, records, ratings and the postseason; DataFrames in, DataFrames out."""
