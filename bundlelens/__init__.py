"""Spark-native analytics over captured web pages, bundles and their tables."""
