"""Spark-native analytics over dated text corpora."""
