"""Spark-native reading, judging and evaluation of short identifiers."""

__all__: list[str] = []
