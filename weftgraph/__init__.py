"""Entity-graph analytics on Spark DataFrames."""
