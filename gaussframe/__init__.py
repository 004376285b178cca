"""gaussframe: Gaussian algebra on Spark DataFrames."""
