"""Cleaning, deduplication, scoring and ranking of inbound sales leads on Spark DataFrames."""

__version__ = "1.0.0"
