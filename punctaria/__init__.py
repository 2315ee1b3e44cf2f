"""Density clustering and point-pattern analytics on Spark DataFrames."""
