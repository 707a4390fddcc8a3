"""Dense-vector similarity search and its evaluation on Spark DataFrames."""
