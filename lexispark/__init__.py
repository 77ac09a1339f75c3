"""Full-text search, ranking and index maintenance on Spark DataFrames."""
