"""Span-annotated text analytics on Spark DataFrames."""
