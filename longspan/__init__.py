"""Panel analytics on Spark DataFrames."""
