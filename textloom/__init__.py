"""Full-text search, ranking and text processing on Spark DataFrames."""

__version__ = "0.1.0"
