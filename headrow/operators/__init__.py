"""Relational operators of the headline archive: DataFrames in, DataFrames out."""
