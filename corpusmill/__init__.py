"""Corpus mining and curation on Spark DataFrames."""
