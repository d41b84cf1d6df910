"""Quality checks and data preparation for trajectory datasets, on Spark DataFrames."""

__version__ = "0.1.0"
