"""Analytics on restriction-site sequencing reads, as Spark DataFrames."""
