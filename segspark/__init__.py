"""Segment reduction, sparse-graph products and their table analytics on Spark DataFrames."""
