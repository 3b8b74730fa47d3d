"""Spark-native decision-data engine."""
