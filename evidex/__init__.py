"""evidex: trade-evidence analytics and corpus preparation on Spark DataFrames."""
