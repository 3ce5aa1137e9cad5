"""emberline: vegetation structure and fire-spread analytics on Spark DataFrames."""
