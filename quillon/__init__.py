"""quillon: panel analytics on Spark DataFrames."""
