"""Corpus analytics on Spark DataFrames: structure, search, resolution, following."""

__version__ = "0.1.0"
