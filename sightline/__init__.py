"""Spark-native analytics for multi-view 3-D reconstruction tables."""
