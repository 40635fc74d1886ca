"""Model-aware analytics on Spark: SQL over columns that services fill on demand."""
