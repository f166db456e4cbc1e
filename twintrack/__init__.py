"""Pairwise pose-track analytics and training-data operators on Spark DataFrames."""
