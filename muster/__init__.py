"""muster: coordination analytics over large comment collections, on Spark DataFrames."""

__version__ = "0.1.0"
