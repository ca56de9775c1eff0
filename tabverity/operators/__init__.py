"""Operators over tables: every function takes DataFrames and returns a DataFrame or a Column."""
