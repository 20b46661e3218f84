"""tidemark: drift-aware anomaly analytics on Spark DataFrames."""
