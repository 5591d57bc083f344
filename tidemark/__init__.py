"""Tidemark: a PySpark-native engine for listening-history and event analytics."""
