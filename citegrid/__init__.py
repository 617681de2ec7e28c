"""Scientometric analytics and corpus building on Spark DataFrames."""
