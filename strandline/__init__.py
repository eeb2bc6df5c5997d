"""Spark-native analytics for multi-omic knowledge graphs."""

__version__ = "0.1.0"
