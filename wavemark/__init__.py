"""Spark-native analytics for sampled recordings, event markers and text corpora."""
