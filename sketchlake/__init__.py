"""Sketch-relational analytics on Spark DataFrames."""
