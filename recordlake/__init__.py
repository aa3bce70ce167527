"""Spark-native analytics over collected public court records."""
