"""Document review and retrieval on Spark DataFrames."""
