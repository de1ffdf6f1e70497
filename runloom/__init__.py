"""Text-index and sequence analytics on Spark DataFrames."""
