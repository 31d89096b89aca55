"""Spark-native analytics for large collections of short support conversations."""
