"""linescope: line-oriented text analytics on Spark DataFrames."""
