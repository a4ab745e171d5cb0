"""quarry: source-audit and corpus analytics on Spark DataFrames."""
