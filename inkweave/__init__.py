"""Inkweave: a PySpark-native engine for text-graph analytics."""
