"""Near-duplicate and log-deduplication analytics on Spark DataFrames."""
