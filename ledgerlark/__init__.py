"""Budget-document analytics on Spark DataFrames."""
