"""splitfold: divide, solve and combine analytics on Spark DataFrames."""
