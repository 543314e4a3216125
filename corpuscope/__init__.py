"""Catalogue, search and processing of a corpus of papers and texts with Spark DataFrames."""
