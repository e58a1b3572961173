"""Farstray: a Spark-native engine that finds outliers in tabular data."""

__version__ = "0.1.0"
