"""tracefold: analytics over captured web traffic, expressed on Spark DataFrames."""
