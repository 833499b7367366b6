"""Spark-native hybrid retrieval, retrieval evaluation and corpus processing."""
