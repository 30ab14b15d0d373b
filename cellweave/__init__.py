"""Cellweave: network and single-cell style analytics on PySpark DataFrames."""
