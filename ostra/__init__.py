"""ostra: retrieval, ranking and corpus preparation on Spark DataFrames."""
