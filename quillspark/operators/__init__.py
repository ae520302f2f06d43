"""Operators: DataFrame in, DataFrame out, set-oriented, nothing collected."""
