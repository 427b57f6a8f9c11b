"""PitSpark: point-in-time research data operators on Spark DataFrames."""

__version__ = "0.1.0"
