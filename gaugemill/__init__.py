"""Spark-native data quality, drift, split, evaluation and lifecycle analytics."""
