"""Knowledge-layer analytics on Spark DataFrames."""
