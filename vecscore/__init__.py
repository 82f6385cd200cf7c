"""Nearest-neighbour scoring of transactions and embeddings on Spark DataFrames."""
