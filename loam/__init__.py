"""loam: content-deduplicating storage analytics on Spark DataFrames."""
