"""Spark-native analytics for context-retrieval evaluation and corpus preparation."""

__version__ = "0.1.0"
