"""Fixed-record, exact-decimal analytics on Spark DataFrames."""
