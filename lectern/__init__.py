"""Spark-native analytics over long-form text, reading events, tags and annotations."""
