"""Operators: DataFrame in, DataFrame or a small fitted object out."""
