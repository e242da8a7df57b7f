"""Quern: a PySpark-native engine for search, ranking and interaction-log analytics."""
