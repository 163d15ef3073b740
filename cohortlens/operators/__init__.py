"""Operators: DataFrame in, DataFrame out, with explicit key columns."""
