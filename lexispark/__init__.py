"""Text analytics and experiment statistics on Spark DataFrames."""
