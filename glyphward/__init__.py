"""Spark-native text-robustness analytics."""
