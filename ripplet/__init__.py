"""A dependency-graph analytics engine on Spark DataFrames."""
