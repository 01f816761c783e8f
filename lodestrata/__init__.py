"""Spark-native analytics for software repositories and text corpora."""
