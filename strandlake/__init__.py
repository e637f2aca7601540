"""strandlake: short-DNA analytics on Spark DataFrames."""
