"""Tidemark: versioned records and training-data preparation on Spark DataFrames."""
