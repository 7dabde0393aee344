"""Spark-native analytics for contactless pulse measurement."""
