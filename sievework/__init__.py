"""Curation, audit and retrieval of image-text corpora on Spark DataFrames."""
