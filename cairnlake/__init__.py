"""Spark-native retrieval, memory and context-shaping engine."""

__version__ = "0.1.0"
