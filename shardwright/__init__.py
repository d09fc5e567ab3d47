"""Shardwright: a Spark-native engine for text knowledge corpora."""
