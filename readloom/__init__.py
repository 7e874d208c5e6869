"""Read-supported path analytics over collections of small directed graphs, on Spark DataFrames."""
