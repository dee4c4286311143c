"""Spark-native code search, retrieval and corpus-preparation engine."""
