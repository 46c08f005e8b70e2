"""Candidate-set analytics on Spark DataFrames."""
