"""Operators: DataFrame in, DataFrame out, columns named by arguments."""
