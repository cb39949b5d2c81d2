"""Source-code analytics on Spark DataFrames."""
