"""Region-by-date analytics on Spark DataFrames."""
