"""Composite jobs: DataFrames in, DataFrames out, built from the operators."""
