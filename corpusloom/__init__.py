"""Spark-native retrieval-corpus analytics."""
