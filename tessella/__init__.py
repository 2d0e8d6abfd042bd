"""Similarity retrieval and set-point planning over operational time series, on Spark."""
