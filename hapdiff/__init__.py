"""Differential methylation regions on Spark DataFrames."""
