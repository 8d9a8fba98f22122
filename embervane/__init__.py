"""Embedding-quality screening and data processing on Spark DataFrames."""
