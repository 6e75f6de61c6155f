"""Itemised-document comparison and corpus preparation on Spark DataFrames."""
