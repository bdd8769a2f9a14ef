"""Telecom billing inventories as DataFrames: scan, classify, chunk, merge, normalise, audit, score and serve."""
