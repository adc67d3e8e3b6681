"""Relational and grouped operators: DataFrame in, DataFrame out."""
