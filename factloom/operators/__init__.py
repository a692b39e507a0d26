"""Operators over facts and edges; each takes and gives DataFrames."""
