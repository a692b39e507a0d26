"""Structural fact-graph analytics expressed on Spark DataFrames."""
