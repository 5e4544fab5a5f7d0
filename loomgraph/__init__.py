"""Spark-native analytics over source-code graphs: every operator is a DataFrame plan."""

__version__ = "0.1.0"
