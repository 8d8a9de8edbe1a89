"""Playtide: audits a music-listening log for metadata drift, on Spark DataFrames."""

__version__ = "0.1.0"
