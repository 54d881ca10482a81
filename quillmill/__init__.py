"""Spark-native text, catalogue and media-timing analytics."""
