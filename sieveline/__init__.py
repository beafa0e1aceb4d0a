"""Spark-native analytics for text and source-code findings."""

__version__ = "0.1.0"
