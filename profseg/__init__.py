"""Profile segmentation analytics on Spark DataFrames."""
