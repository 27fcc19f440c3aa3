"""Skein: code retrieval, code analytics and versioned snippet indexes on Spark DataFrames."""
